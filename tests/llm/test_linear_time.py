"""Personal data and languages: time in proportion to the text, exact against plain versions, clashing columns."""

import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)


@pytest.mark.parametrize("text", ["語" * 1_000_000, "語" * 500_000 + "(dot)" + "語" * 500_000, "x" * 1_000_000 + "@", "a at b " * 100_000, "(at)" * 200_000, "- " * 300_000 + "1"])
def test_unspaced_texts_are_linear(text):
    from dwellgraph.llm import pii

    began = time.time()
    found = sum(len(tokens) for _, tokens, _ in pii.windows(text))
    pii.base_spans(text)
    assert time.time() - began < 5 and found <= 2 * len(text)


def test_long_texts_are_found_in(spark):
    """An entity in the midst of a megabyte without spaces, decoded in a moment."""
    from dwellgraph.llm import pii

    text = "語" * 500_000 + "anna(at)mail(dot)example(dot)com" + "語" * 500_000 + " 10.20.30.40 " + "語"
    began = time.time()
    crf = pii.train(["write to anna.k@mail.example.com or call +1 (234) 555-1234 now"] * 40)
    got = pii.find(docs(spark, [(1, text), (1, text)]), crf).collect()
    assert time.time() - began < 40 and [r.n_ip for r in got] == [1, 1] and got[0].spans == got[1].spans


def test_stretches_give_the_best_segmentation_of_whole_windows():
    """Long windows are cut into stretches: decoding these finds what decoding the window in one finds."""
    from dwellgraph.llm import pii

    rng = random.Random(4)
    crf = pii.train([f"mail anna{i}@host{i}.example.com, card 4539 1488 0343 6467, call +1 (234) 555-{1000 + i}" for i in range(40)])
    for _ in range(30):
        chunks = ["".join(rng.choice(["é", "ab", "7", "-", ".", "(dot)", "12"]) for _ in range(rng.randint(20, 90))), rng.choice(["anna(at)mail(dot)com", "4539.1488.0343.6467", "00 1 234 555-1234"])]
        text = "é" * 80 + chunks[0] + "é" * 80 + "." + chunks[1] + "." + "é" * 80
        (start, end) = next(iter(pii._runs(text)))
        tokens = pii._TOKEN.findall(text[start:end])
        at = [start, *(start + n for n in itertools.accumulate(map(len, tokens)))]
        whole = {(at[i], at[j], k) for i, j, k in crf.decode(tokens)}
        parts = set()
        for offset, own, word in itertools.takewhile(lambda w: w[0] < end, pii.windows(text)):  # noqa: B023
            at = [offset, *(offset + n for n in itertools.accumulate(map(len, own)))]
            parts |= {(at[i], at[j], k) for i, j, k in crf.decode(own, word)}
        assert parts == whole


def all_segmentations(crf, tokens):
    """(score, entities) of every segmentation of a short window."""
    from dwellgraph.llm import pii

    window = pii.Window(tokens)
    ending = [[], *(list(crf.ending(window, j)) for j in range(1, len(tokens) + 1))]

    def told(j):
        if not j:
            yield 0.0, ()
            return
        for i, k, _, s in ending[j]:
            for score, rest in told(i):
                yield score + s, (*rest, (i, j, k)) if k else rest

    return list(told(len(tokens)))


def test_decoding_and_learning_equal_all_segmentations():
    from dwellgraph.llm import pii

    rng = random.Random(9)
    for _ in range(25):
        tokens = [rng.choice(["12", "555", "1234567", ".", "-", "at", "mail", "dot", "com", " ", "@"]) for _ in range(rng.randint(3, 8))]
        crf = pii.SemiCrf()
        for j in range(1, len(tokens) + 1):
            for _, k, features, _ in crf.ending(pii.Window(tokens), j):
                crf.weights.update({(k, f): rng.uniform(-1, 1) for f in features if (k, f) not in crf.weights})
        every = all_segmentations(crf, tokens)
        best = max(every)
        assert abs(best[0] - max(s for s, e in every if e == tuple(crf.decode(tokens)))) < 1e-9
        # A step of learning is the gradient: what the gold has of a feature, less what all segmentations have by their probability.
        gold = list(rng.choice(every)[1])
        total = np.logaddexp.reduce([s for s, _ in every])
        window = pii.Window(tokens)
        of = {(i, j, k): f for j in range(1, len(tokens) + 1) for i, k, f, _ in crf.ending(window, j)}
        want = Counter()
        for share, entities in [(1.0, tuple(gold)), *((-float(np.exp(s - total)), e) for s, e in every)]:
            covered = {t for i, j, _ in entities for t in range(i, j)}
            for segment in [*entities, *((t, t + 1, 0) for t in range(len(tokens)) if t not in covered)]:
                for f in of[segment]:
                    want[segment[2], f] += share
        before = dict(crf.weights)
        crf.learn(tokens, "", gold, 1.0)
        assert all(abs(crf.weights.get(k, 0.0) - before.get(k, 0.0) - v) < 2e-3 for k, v in want.items())


def test_field_finds_disguises_it_was_not_trained_on():
    """Separators and words that disguised() never makes."""
    from dwellgraph.llm import pii

    rng = random.Random(11)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        body = "4" + n(14)
        return next(body + d for d in "0123456789" if pii.luhn(body + d))

    say = lambda: " ".join(rng.choice(["the", "house", "on", "hill", "with", "garden", "12", "rooms"]) for _ in range(9))
    plain = [f"{say()} {rng.choice(['anna', 'karl'])}{n(2)}@mail.example.com {say()} {'.'.join(str(rng.randint(1, 254)) for _ in range(4))} {say()} +1 ({rng.randint(200, 989)}) 555-{n(4)} {say()} {card()} {say()}" for _ in range(60)]
    crf = pii.train(plain)
    made = []
    for _ in range(40):
        digits = card()
        made += [("email", f"{rng.choice(['mia', 'jo'])}{n(2)}{{at}}post{{dot}}example{{dot}}org"), ("ip", "-".join(str(rng.randint(1, 254)) for _ in range(4))), ("card", "*".join(digits[i : i + 4] for i in range(0, 16, 4))), ("phone", f"{n(3)}·{n(3)}·{n(4)}")]
    hit = Counter()
    for kind, entity in made:
        before = say() + " "
        text = before + entity + " " + say()
        for offset, tokens, word in pii.windows(text):
            at = [offset, *(offset + x for x in itertools.accumulate(map(len, tokens)))]
            hit[kind] += any((at[i], at[j]) == (len(before), len(before) + len(entity)) for i, j, _ in crf.decode(tokens, word))
    print(dict(hit))
    assert sum(hit.values()) >= 0.5 * len(made)


def plain_profile(texts):
    count = Counter()
    for text in texts:
        word = ""
        for c in text.lower() + " ":
            if c.isalpha():
                word += c
                continue
            framed = f" {word} "
            count.update(framed[i : i + k] for k in (1, 2, 3) for i in range(len(framed) - k + 1) if word and framed[i : i + k] != " ")
            word = ""
    return [g for g, _ in sorted(count.items(), key=lambda p: (-p[1], [ord(c) for c in p[0]]))][:300]


def test_profiles_and_distances_equal_plain_ones(spark):
    from dwellgraph.llm import language as x

    rng = random.Random(2)
    letters = {"aa": "abcdeé ", "bb": "abcxyzß ", "cc": "жзиабв ", "dd": "abcdeé "}
    known = {k: ["".join(rng.choice(a) for _ in range(rng.randint(0, 400))) + rng.choice(["", " x²y ½ 12_3"]) for _ in range(12)] for k, a in letters.items()}
    known["dd"] = known["aa"]
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, ts in known.items() for t in ts)]
    frame = spark.createDataFrame([*rows, (900, None, "aa"), (901, "text", None)], "doc_id bigint, text string, lang string")
    got = x.profiles(frame)
    number = lambda g: sum(ord(c) << (21 * (2 - i)) for i, c in enumerate(g))
    want = {k: plain_profile(ts) for k, ts in known.items()}
    assert got == {k: [number(g) for g in gs] for k, gs in want.items()}
    asked = ["".join(rng.choice(letters[rng.choice("abcd") * 2] + "Ж1²") for _ in range(n)) for n in (1, 3, 30, 300, 3000) * 4] + ["½²", "", None]
    told = {r.doc_id: r for r in x.predict(spark.createDataFrame([(i, t, 7, "p") for i, t in enumerate(asked)], "doc_id bigint, text string, score int, _p string"), got).collect()}
    assert told[0]._p == "p"
    for i, t in enumerate(asked):
        own = plain_profile([t or ""])
        apart = sorted((sum(abs(p.index(g) - r) if g in p else 300 for r, g in enumerate(own)), k) for k, p in want.items())
        if not own:
            assert (told[i].lang_pred, told[i].score) == ("und", 0.0)
        else:
            assert told[i].lang_pred == apart[0][1] != "dd" and abs(told[i].score - (1 - apart[0][0] / apart[1][0] if apart[1][0] else 0)) < 1e-12


def test_words_are_found_fast():
    from dwellgraph.llm import language as x

    text = "some words, und ß Wörter 12 x²y " * 30_000
    began = time.time()
    words = x.words_of(text)
    assert time.time() - began < 2 and words[:9] == ["some", "words", "und", "ß", "Wörter", "x", "y", "some", "words"]
    assert not re.search(r"[\d_²]", "".join(words))


def test_pipeline_keeps_a_clashing_score(spark, tmp_path):
    import corpus_pipeline

    top = str(tmp_path)
    spark.createDataFrame([(1, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    frame = spark.createDataFrame([(1, "a house", 0.25, "s")], "doc_id bigint, text string, _score double, _SCORE_ string")
    assert [tuple(r) for r in corpus_pipeline.drop_toxic(spark, frame, top).collect()] == [(1, "a house", 0.25, "s")]


def test_a_worker_keeps_the_memory_of_one_operator():
    from dwellgraph.llm import bpe, common, toxicity

    toxicity.features("some plain words")
    assert len(common.held("words", dict)) == 3
    ranks = {bytes([b]): b for b in range(256)}
    encoder = bpe.encoder_of(ranks, r"\S+|\s+")
    assert bpe.encoder_of(ranks, r"\S+|\s+") is encoder and list(common._HELD) != ["words"]
    toxicity.features("plain")
    assert list(common._HELD) == ["words"] and len(common.held("words", dict)) == 1


def test_lines_are_looked_up_without_another_shuffle(spark):
    """A table in buckets is joined and grouped by its column where it lies, and leaves no name behind."""
    from dwellgraph.llm import common, line_dedup

    rows = spark.createDataFrame([(i, f"a line of the house with the number {i}") for i in range(300)], "lid long, norm string")
    kept = common.bucketed(rows, "distinct", "lid", "zstd")
    found = kept.join(spark.range(0, 300, 3).withColumnRenamed("id", "lid").hint("shuffle_hash"), "lid", "left_semi")
    plan = line_dedup.minwise(found, line_dedup._SEEDS[:3])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and sorted(r.lid for r in found.collect()) == list(range(0, 300, 3))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, rows.collect())) and not spark.catalog.listTables()
    one = line_dedup.dedup_lines(docs(spark, [(1, "a line alone\n\nand one more"), (2, None)])).orderBy("doc_id").collect()
    assert [(r.text, r.n_lines, r.n_removed) for r in one] == [("a line alone\n\nand one more", 3, 0), (None, 0, 0)]


def test_texts_hashed_together_have_the_hashes_of_each():
    """Decontamination: no placement reaches over a border, and short, empty and long texts are all there."""
    from dwellgraph.llm import decontaminate as d

    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 9, n).astype(np.uint64) for n in (0, 1, 4, 5, 6, 7, 8, 9, 30, 0, 400, d.TOKENS_AT_ONCE + 5, 3, 0)]
    masks, got = (*d.MASKS, "1", "111"), []
    for low, part in d.together(iter(texts)):
        got += [(low + int(i), int(h), int(at)) for i, h, at in zip(*d.hashes_of_texts(part, masks, lambda h: np.flatnonzero(h % 2 == 0)), strict=True)]
    want = [(i, int(h), int(at)) for i, t in enumerate(texts) for h, at in zip(*d.spaced_hashes(t, masks), strict=True)]
    want = [(i, h - (1 << 64) if h >> 63 else h, at) for i, h, at in want if h % 2 == 0]
    assert got == sorted(want)
    assert [len(part) for _, part in d.together(iter(texts))] == [11, 1, 2]
