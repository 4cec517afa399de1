"""Training-data operators against brute force and on odd inputs."""

import gzip
import hashlib

import numpy as np
import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_lines string, score string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "x", "y") for i, t in rows], DOCS)


def test_near_duplicates_odd_inputs(spark):
    from dwellgraph.llm.near_dedup import near_duplicates

    long = " ".join(f"w{i}" for i in range(400))
    rows = [(5, long), (3, long), (3, long), (9, long + " tail"), (7, None), (8, ""), (10, "a b"), (11, "A\tb"), (None, long)]
    got = near_duplicates(docs(spark, rows), words=3, percent=85).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[5] == [(398, 3, False)] and by[3] == [(398, 3, True)] * 2 and by[9] == [(399, 3, False)]
    assert by[7] == [(0, 7, True)] and by[8] == [(0, 8, True)] and by[10] == [(1, 10, True)] and by[11] == [(1, 10, False)]
    assert by[None] == [(398, 3, False)]
    assert near_duplicates(docs(spark, []), words=3).count() == 0


def test_near_duplicates_dense_group(spark):
    """A group of near copies far above a bucket's limit comes out as brute force has it."""
    from dwellgraph.llm.near_dedup import near_duplicates, shingle_set

    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(90):
        words = list(base)
        for j in rng.integers(0, 200, rng.integers(0, 9)):
            words[j] = f"x{i}-{j}"
        rows.append((i, " ".join(words)))
    sets = {i: set(shingle_set(t, 3).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(spark, rows), words=3, percent=85).collect()}
    assert got == {i: top(i) for i in sets}


def test_lines(spark):
    from dwellgraph.llm.line_dedup import dedup_lines, without_repeats

    line = "the quick brown fox jumps over the lazy dog while the band plays on and on until the morning light"
    near = line.replace("morning", "evening")
    frame = docs(spark, [(1, f"{line}\n\nonly here, nowhere else"), (2, f"other words stand in this one\n{near}"), (3, line), (4, None), (5, ""), (None, line)])
    got = {r.doc_id: r for r in dedup_lines(frame).collect()}
    assert got[1].text == f"{line}\n\nonly here, nowhere else" and got[1].n_lines == 3 and got[1].n_removed == 0
    assert got[2].text == "other words stand in this one" and got[2].n_removed == 1
    assert got[3].text == "" and got[4].text is None and got[4].n_lines == 0 and got[5].text == "" and got[None].text == line
    assert sorted(r.doc_id or 0 for r in without_repeats(frame).collect()) == [0, 1, 2, 4, 5]
    assert dedup_lines(docs(spark, [])).count() == 0


def test_bpe_as_tiktoken(spark):
    tiktoken = pytest.importorskip("tiktoken")
    pytest.importorskip("public_tokenizers")
    from dwellgraph.llm.bpe import StreamDecoder, encode_documents, public_vocabulary

    ranks, pattern = public_vocabulary()
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "Hello  world\n\n\tÀ", "x" * 5000, "日本語 ☃ 🙂", " lead", "tail   ", "a'll 12345 $$$"]
    got = {r.doc_id: r for r in encode_documents(docs(spark, list(enumerate(texts))), ranks, pattern, with_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = theirs.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    decoder = StreamDecoder({v: k for k, v in ranks.items()})
    assert "".join(decoder.feed([x]) for x in theirs.encode_ordinary("日本語🙂")) + decoder.feed((), final=True) == "日本語🙂"


def test_leaks_tolerate_substitutions(spark):
    from dwellgraph.llm.decontaminate import decontaminate, leaks

    item = " ".join(f"token{i}" for i in range(30))
    changed = item.replace("token7 ", "other ").replace("token19 ", "more ")
    frame = docs(spark, [(1, f"before {changed} after"), (2, "nothing of it here at all"), (3, None), (4, ""), (None, item)])
    bench = spark.createDataFrame([(0, item), (1, None), (2, "a b")], "item_id bigint, text string")
    got = leaks(frame, bench).collect()
    assert [(r.doc_id, r.item_id, r.start, r.end, r.equal) for r in got] == [(1, 0, 1, 31, 28)]
    assert sorted(r.doc_id or 0 for r in decontaminate(frame, bench).collect()) == [0, 2, 3, 4]
    assert leaks(docs(spark, []), bench).count() == 0 and leaks(frame, bench.limit(0)).count() == 0


def test_warc_salvage(spark):
    from dwellgraph.llm import warc

    rows = [(2, "u", "same"), (1, "u", "same"), (3, None, None), (4, "v", ""), (5, "w", "é\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert got[2].refers_to == 1 and got[2].record_type == "revisit" and got[1].record_type == "response"
    assert got[4].refers_to == 3 and got[5].payload_bytes == len("é\r\nWARC/1.1\r\n".encode()) and got[3].payload_bytes == 0
    one = "".join(r.record + "\r\n" for r in warc.records(pages.where("page_id = 1")).collect()).encode()
    two = "".join(r.record + "\r\n" for r in warc.records(pages.where("page_id = 5")).collect()).encode()
    found, gaps = warc.parse(one + b"junk" + two[:-9] + gzip.compress(one) + b"\x1f\x8bbroken" + two)
    assert [b for _, b in found] == [b"same", b"same", "é\r\nWARC/1.1\r\n".encode()] and len(gaps) == 2
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_pii_base_and_field(spark):
    from dwellgraph.llm import pii

    text = "mail a.b@c-d.example.com or 10.0.0.255, 300.1.1.1; 4539 1488 0343 6467 and +1 (743) 555-3824."
    assert [k for *_, k in pii.base_spans(text)] == ["email", "ip", "card", "phone"]
    crf = pii.train([f"call +1 ({200 + i}) 555-{1000 + i} now 12 items {i}.5 at 10.0.0.{i}" for i in range(60)])
    got = {r.doc_id: r for r in pii.find(docs(spark, [(1, text), (2, None), (3, "ring 1 (743) 555-3824 today")]), crf).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1)
    assert got[2].spans == "" and "phone:5:21" in got[3].spans and got[3].n_phone == 0


def test_toxicity_held_out(spark):
    from dwellgraph.llm import toxicity

    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{x}" for x in rng.integers(0, 300, 40)]
        bad = i % 4 == 0
        rows.append((i, " ".join(words + ["scoundrel"] * bad)))
        labels.append((i, 1, int(bad)))
    frame, marks = docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    weights = toxicity.fit(toxicity.learning_rows(frame, marks))
    got = {r.doc_id: r.score for r in toxicity.score(frame.union(docs(spark, [(None, None)])), weights).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(600)) and 0 <= got[None] <= 1
    empty = toxicity.fit(toxicity.learning_rows(frame.limit(0), marks))
    assert toxicity.score(frame, empty).first().score == 0.5


def test_language(spark):
    from dwellgraph.llm import language

    text = {"en": "the people of this land and their houses", "de": "die leute und ihre häuser sind schön"}
    known = language.profiles(spark.createDataFrame([(t, k) for k, t in text.items()] + [(None, "en"), ("x", None)], "text string, lang string"))
    got = {r.doc_id: r.lang_pred for r in language.predict(docs(spark, [(1, "the house of people"), (2, "ihre leute"), (3, None), (4, "12 !?")]), known).collect()}
    assert got == {1: "en", 2: "de", 3: "und", 4: "und"}


def test_licenses(spark):
    from dwellgraph.llm.licenses import scan

    frame = docs(spark, [(1, "prose\nReleased under the MIT License."), (2, "no such thing"), (3, None), (4, ""), (5, "licensed under the\nApache License version 2.0")])
    got = sorted((r.doc_id, r.license) for r in scan(frame).collect())
    assert got == [(1, "MIT"), (5, "Apache-2.0")]


def test_embeddings(spark):
    from dwellgraph.llm.embedding_dedup import near_vectors

    rng = np.random.default_rng(3)
    base = rng.normal(size=(20, 16))
    vectors = np.concatenate([base, base + rng.normal(size=base.shape) * 0.05, base[:3]])
    rows = [(i, v.tolist(), int(i % 20 % 2)) for i, v in enumerate(vectors)]
    rows += [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] * 16, 1), (103, base[1].tolist(), None), (104, [None] * 16, 1), (105, [1.0], 1)]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for i in range(len(vectors)):
        near = [j for j in range(len(vectors)) if j != i and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.93]
        assert got[i].n_links == len(near) and got[i].component_id == min([i, *near])
    assert all(got[i].n_links == 0 and got[i].kept for i in range(100, 106))


def test_merged_labels_equal_components_of_all_edges(spark):
    from dwellgraph.llm.components import connected_components, merged

    edges = [(1, 2), (2, 3), (5, 6), (8, 9), (3, 5), (10, 11), (9, 10), (12, 12), (6, 1)]
    t = lambda rows: spark.createDataFrame(rows, "a bigint, b bigint")
    whole = {r.id: r.component_id for r in connected_components(t(edges)).collect()}
    parts = merged(connected_components(t(edges[:4])), t(edges[4:])).collect()
    assert {r.id: r.component_id for r in parts} == whole and len(parts) == len(whole)
    assert merged(connected_components(t([])), t(edges)).count() == len(whole)


def test_wide_buckets_are_compared_across_components(spark):
    """A single link between two components that do not hold the bucket's pivot is found."""
    from dwellgraph.llm.paths import link

    parts = [range(20 * k, 20 * k + 20) for k in range(4)]
    wide = [(7, i) for part in parts for i in part]
    rows = spark.createDataFrame(wide + [(100 + k, i) for k, part in enumerate(parts) for i in part], "node bigint, id bigint")
    verify = lambda pairs: pairs.where("a div 20 = b div 20 or (a = 25 and b = 45) or (a = 47 and b = 63)")
    got = {r.id: r.component_id for r in link([rows], lambda wide, level: wide, verify).collect()}
    assert got == {i: 0 if i < 20 else 20 for _, i in wide}


def test_branching_keeps_pairs_at_the_threshold(spark, monkeypatch):
    """Pairs at the threshold among many documents that are alike, but not linked, survive branching."""
    from dwellgraph.llm import paths
    from dwellgraph.llm.near_dedup import near_duplicates, shingle_set

    monkeypatch.setattr(paths, "WORK", 0, raising=False)
    rng = np.random.default_rng(4)
    base, rows = [f"w{i}" for i in range(300)], []
    for pair in range(150):
        places = rng.choice(300, 10, replace=False)
        for side, own in enumerate((places[3:7], places[7:])):
            words = list(base)
            for j in (*places[:3], *own):
                words[j] = f"x{pair}-{j}"
            rows.append((2 * pair + side, " ".join(words)))
    sets = {i: set(shingle_set(t, 3).tolist()) for i, t in rows}
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    linked = {2 * p for p in range(150) if share(2 * p, 2 * p + 1) >= 0.85}
    assert len(linked) > 100
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(spark, rows), words=3, percent=85).collect()}
    assert {i for i in linked if got[i] != got[i + 1]} == set()


def test_lines_that_differ_at_the_start_or_have_no_spaces(spark):
    """Lines whose first characters differ, or that hold no spaces, are found as the verified sets have it."""
    from dwellgraph.llm.line_dedup import dedup_lines

    rng = np.random.default_rng(5)
    rest = ["".join(chr(97 + x) for x in rng.integers(0, 26, 90)) for _ in range(40)]
    rows = [(2 * i + k, f"{'https' if k else 'http'}://{t}") for i, t in enumerate(rest) for k in (0, 1)]
    rows += [(100 + 2 * i + k, f"{k + 1},{t[::-1]}") for i, t in enumerate(rest) for k in (0, 1)]
    got = {r.doc_id: r.n_removed for r in dedup_lines(docs(spark, rows)).collect()}
    assert got == {i: i % 2 for i, _ in rows}


def test_lines_fold_case_and_white_space(spark, monkeypatch):
    """Lines that differ in case or white space only are one; the same where all wide buckets are branched."""
    from dwellgraph.llm import paths
    from dwellgraph.llm.line_dedup import dedup_lines

    monkeypatch.setattr(paths, "WORK", 0, raising=False)
    rows = [(1, "Read the terms below"), (2, "READ THE\tTERMS  BELOW"), (3, " \t"), (4, " \t")]
    body = "of this long line that many others share, word by word, up to a tail of its own: "
    rng = np.random.default_rng(6)
    for i in range(60):
        tail = "".join(chr(97 + x) for x in rng.integers(0, 26, 40))
        rows += [(100 + 2 * i, body + tail), (101 + 2 * i, (body + tail[:-8]).upper() + f"{i:08d}")]
    got = {r.doc_id: r.n_removed for r in dedup_lines(docs(spark, rows)).collect()}
    assert got == {i: int(i == 2 or i > 100 and i % 2) for i, _ in rows}
