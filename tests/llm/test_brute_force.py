"""Operators against plain brute-force versions, and on inputs that once broke them."""

import gzip
import hashlib
import random
import re
import time

import numpy as np
import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)


def components(links, ids):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_lines_equal_exact_jaccard(spark):
    """Kept lines are those of an exact comparison of all pairs: unspaced, Thai and URL lines, and one giant bucket."""
    from dwellgraph.llm.line_dedup import dedup_lines

    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(2, 9)))
    made = []
    for k in range(60):
        line = " ".join(word(letters) for _ in range(14)) if k % 3 else "".join(rng.choice("กขคงจฉชซญดตถทนบปผพมยรลวสหอ") for _ in range(70))
        made += [line, line[: rng.randint(1, 5)] + "X" + line[6:], line.upper()]
    made += ["https://example.org/" + "".join(rng.choice(letters) for _ in range(60)) for _ in range(60)]
    body = "the one long opening that sixty lines share before they go on to something of their own: "
    made += [body + "".join(rng.choice(letters) for _ in range(9)) for _ in range(60)] + ["", "  ", "abc", "abc", "ABC ", "x" * 30_000]
    norm = [re.sub(r"\s+", " ", t.lower()).strip(" ") for t in made]
    sets = [{t} if len(t) < 5 else {t[i : i + 5] for i in range(len(t) - 4)} for t in norm]
    links = [(a, b) for b in range(len(made)) for a in range(b) if norm[a] and norm[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    want = components(links, range(len(made)))
    frame = docs(spark, list(enumerate(made))).selectExpr("*", "doc_id removed_key", "text REMOVED_AT", "1 n_lines")
    got = {r.doc_id: r.n_removed for r in dedup_lines(frame).collect()}
    assert got == {i: int(want[i] != i) for i in range(len(made))}


def test_one_long_piece_keeps_the_machine_small(monkeypatch):
    tiktoken = pytest.importorskip("tiktoken")
    pytest.importorskip("public_tokenizers")
    from dwellgraph.llm import bpe

    monkeypatch.setattr(bpe, "STATE_LIMIT", 300)
    ranks, pattern = bpe.public_vocabulary()
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(ranks, pattern)
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgehinorst") for _ in range(20_000))
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == theirs.encode_ordinary(text)
    assert len(encoder.machine.configs) <= 302


def test_leaks_equal_brute_force(spark):
    """Every stretch of every diagonal is tried by the brute-force version."""
    from dwellgraph.llm import decontaminate as d

    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    take = lambda n: [rng.choice(words) for _ in range(n)]
    items = [take(n) for n in (1, 2, 5, 5, 12, 30, 78)] + [["a"] * 20]
    items[0] = ["rareword"]
    rows = []
    for i in range(40):
        own = list(items[i % len(items)])
        for _ in range(rng.randint(0, max(0, len(own) // 6))):
            own[rng.randrange(len(own))] = "changed"
        rows.append((i, " ".join(take(30) + own + take(30))))
    gap = list(items[6])
    gap[20:29], gap[49:58] = ["x1"] * 9, ["x2"] * 9  # three runs of 20 with two gaps rewritten
    rows += [(100, " ".join(gap)), (101, " ".join(["a"] * 300)), (102, " ".join(items[2])), (103, None), (104, "")]

    def brute(text, item):
        t, m, best = text.split(), len(item), 0
        for lo in range(-m + 1, len(t)):
            same = [0 <= lo + k < len(t) and t[lo + k] == item[k] for k in range(m)]
            inside = [0 <= lo + k < len(t) for k in range(m)]
            for s in range(m):
                equal = 0
                for e in range(s, m):
                    if not inside[e] or not inside[s]:
                        break
                    equal += same[e]
                    if same[s] and same[e] and 5 * equal >= 4 * (e - s + 1) and equal > best:
                        best = equal
        return best

    # A stretch is found where a mask fits in it; so the brute-force version asks for a run of six equal tokens, or a whole short item.
    got = {(r.doc_id, r.item_id): r.equal for r in d.leaks(docs(spark, rows), spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)] + [(50, None)], "item_id bigint, text string")).collect()}
    for i, text in rows:
        for k, item in enumerate(items):
            equal = brute(text or "", item)
            need = min(13, 0.8 * len(item)) if len(item) >= 6 else len(item)
            sure = len(item) < 6 or any(" ".join(item[s : s + 6]) in (text or "") for s in range(len(item) - 5))
            if equal >= need and sure:
                assert got.get((i, k)) == equal, (i, k)
            if equal < need:
                assert (i, k) not in got
    assert (102, 2) in got and (100, 6) in got
    chinese = "从前有一个小村庄住着一位老人他每天都去河边钓鱼"
    leak = d.leaks(docs(spark, [(1, f"“{chinese}”。")]), spark.createDataFrame([(0, chinese)], "item_id bigint, text string")).collect()
    assert [(r.doc_id, r.equal) for r in leak] == [(1, len(chinese))]
    clash = docs(spark, rows).selectExpr("*", "doc_id leaking", "text doc")
    assert d.decontaminate(clash, spark.createDataFrame([(2, " ".join(items[2]))], "item_id bigint, text string")).where("doc_id = 102").count() == 0


def test_archives_lose_no_page(spark):
    from dwellgraph.llm import warc

    rows = [(1, "u" * 70_000, "one"), (2, "v", "x" * 200_000), (3, None, None), (4, "w", "one"), (4, "w", "one")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    assert got == [(1, 3, "response", None), (2, 200_000, "response", None), (3, 0, "response", None), (4, 3, "revisit", 1), (4, 3, "revisit", 1)]


def test_many_members_are_read_in_linear_time():
    from dwellgraph.llm import warc

    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 500\r\n\r\n" + bytes(range(250)) * 2 + b"\r\n\r\n"
    member = gzip.compress(record)
    began = time.time()
    found, gaps = warc.parse(member * 4000)
    first = time.time() - began
    assert len(found) == 4000 and not gaps
    began = time.time()
    found, gaps = warc.parse((member + b"\x1f\x8b\x08") * 16_000)
    assert len(found) == 16_000 and time.time() - began < 12 * first + 2
    found, gaps = warc.parse(b"WARC/1.1\r\n" * 20_000 + record)
    assert len(found) == 1 and gaps == [(0, 200_000, "header without end")]


def test_base_spans_equal_the_patterns():
    """The fixed patterns, applied as they are written, to random texts."""
    from dwellgraph.llm import pii

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def plain(text):
        out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
        out += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
        out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))

    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(["1", "25", "0", ".", "@", "a", "-", " ", "+", "(", ")", "4539148803436467", "x.y", "+1", "%", "é"]) for _ in range(rng.randint(1, 40)))
        assert pii.base_spans(text) == plain(text)
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [(0, 5006, "ip")]


def test_field_finds_what_the_patterns_miss(spark):
    """Recall of disguised entities and of secrets on texts that the fit has not seen; clean texts stay clean."""
    from dwellgraph.llm import pii

    rng = random.Random(6)

    def entity(kind):
        n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
        if kind == "email":
            return f"{rng.choice(['anna', 'karl', 'mia', 'jo'])}.{n(2)}@mail{n(1)}.example.com"
        if kind == "ip":
            return ".".join(str(rng.randint(1, 254)) for _ in range(4))
        if kind == "phone":
            return f"+1 ({rng.randint(200, 989)}) 555-{n(4)}"
        body = "4" + n(14)
        return next(body + d for d in "0123456789" if pii.luhn(body + d))

    say = lambda: " ".join(rng.choice(["the", "house", "on", "hill", "with", "garden", "and", "12", "rooms", "in", "2023"]) for _ in range(12))
    kinds = [k for _ in range(60) for k in pii.KINDS]
    texts = [f"{say()} {entity(k)} {say()}" for k in kinds] + [f'{say()} token = "{hashlib.sha1(bytes([i])).hexdigest()}" {say()}' for i in range(60)] + [say() for _ in range(60)]
    crf = pii.train(texts)
    rows, want = [], {}
    for i, k in enumerate(kinds):
        before, made = say() + " ", pii.disguised(entity(k), k, rng)
        rows.append((i, before + made + " " + say()))
        want[i] = f"{k}:{len(before)}:{len(before) + len(made)}"
    for i in range(300, 330):
        before, made = say() + ' token = "', hashlib.sha1(bytes([i % 256, 7])).hexdigest()
        rows.append((i, before + made + '" ' + say()))
        want[i] = f"secret:{len(before)}:{len(before) + len(made)}"
    rows += [(i, say()) for i in range(400, 440)] + [(500, None), (501, ""), (502, "9 " * 50_000), (503, "7" * 300_000)]
    got = {r.doc_id: r for r in pii.find(docs(spark, rows), crf).collect()}
    hit = sum(want[i] in got[i].spans.split(",") for i in want)
    assert hit >= 0.8 * len(want) and sum(bool(got[i].spans) for i in range(400, 440)) <= 2
    assert got[500].n_spans == got[501].n_spans == 0 and got[502].n_card == got[503].n_card == 0
    assert all(got[i].n_spans == (len(got[i].spans.split(",")) if got[i].spans else 0) for i in want)


def test_learner_equals_plain_ftrl():
    """The vectorised learner against one that keeps each coordinate in a dictionary."""
    from dwellgraph.llm import toxicity as t

    rng = np.random.default_rng(7)
    rows = [(np.unique(rng.integers(0, 200, 15)).astype(np.int32), int(rng.random() < 0.3)) for _ in range(150)]
    z, n, size = {}, {}, 1 << t.BITS

    def weight(i):
        lasso = 0.0 if i == size else t.L1
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= lasso else -(v - np.sign(v) * lasso) / ((t.BETA + np.sqrt(n.get(i, 0.0))) / t.ALPHA + t.L2)

    for _ in range(t.EPOCHS):
        for at, y in rows:
            w = {int(i): weight(int(i)) for i in [*at, size]}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i, v in w.items():
                grown = n.get(i, 0.0) + g * g
                z[i] = z.get(i, 0.0) + g - (np.sqrt(grown) - np.sqrt(n.get(i, 0.0))) / t.ALPHA * v
                n[i] = grown
    got = t.ftrl(rows).dense()
    assert np.allclose(got[:200], [weight(i) for i in range(200)], atol=1e-9)


def test_language_equals_brute_force(spark):
    from collections import Counter

    from dwellgraph.llm import language as x

    texts = {"en": "the people of this land and their old houses by the sea", "de": "die leute und ihre häuser sind schön und alt am meer", "fr": "les gens de ce pays et leurs vieilles maisons près de la mer"}

    def profile(text):
        count = Counter(g for w in re.findall(r"[^\W\d_]+", text.lower()) for s in [f" {w} "] for k in (1, 2, 3) for g in (s[i : i + k] for i in range(len(s) - k + 1)) if g != " ")
        return [g for g, _ in sorted(count.items(), key=lambda p: (-p[1], [ord(c) << 42 >> 21 * i for i, c in enumerate(p[0])]))]

    known = x.profiles(spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(texts.items())], "doc_id bigint, text string, lang string"))
    for k, t in texts.items():
        assert Counter(known[k]) and len(known[k]) == min(x.RANKS, len(profile(t)))
    asked = ["an old house by the sea", "ein haus am meer", "une maison de la mer", "sea"]
    got = {r.doc_id: r.lang_pred for r in x.predict(docs(spark, [*enumerate(asked), (10, "² ½ Ⅷ"), (11, None), (12, ""), (13, "sea " * 20_000)]), known).collect()}
    assert [got[i] for i in range(3)] == ["en", "de", "fr"] and got[10] == got[11] == got[12] == "und" and got[13] == got[3]


def test_pipeline_on_odd_documents(spark, tmp_path):
    """Each stage takes nulls, empty and repeated rows and clashing columns, and hands on the columns of documents."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rng = random.Random(8)
    prose = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    shared, item = prose(60), prose(40)
    rows = [(i, prose(80)) for i in range(60)] + [(60, shared + "\n" + prose(90)), (61, shared + "\n" + prose(90)), (62, item), (63, rows_text := prose(90)), (64, rows_text + " tail"), (65, None), (66, ""), (66, ""), (None, "no key")]
    rows += [(i, prose(40) + " scoundrel scoundrel " + prose(10)) for i in range(100, 130)]
    frame = docs(spark, rows)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i in [*range(60), *range(100, 130)]], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = frame
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        got = corpus_pipeline.materialize(stage(spark, got, str(tmp_path)), name)
        kept[name] = [r.doc_id for r in got.select("doc_id").collect()]
        assert name == "byte_bpe" or got.columns == frame.columns
    assert set(range(60)) <= set(kept["toxicity"]) and {65, 66, None} <= set(kept["toxicity"])
    assert 61 in kept["line_dedup"] and 63 in kept["near_dedup"] and 64 not in kept["near_dedup"]
    assert 62 in kept["near_dedup"] and 62 not in kept["decontamination"] and set(range(60)) <= set(kept["decontamination"])
    assert sorted(x or -1 for x in kept["byte_bpe"]) == sorted(x or -1 for x in kept["decontamination"])


@pytest.mark.parametrize("block", [8192, 40])
def test_vectors_of_several_blocks_and_a_dense_group(spark, monkeypatch, block):
    """All links of an exact comparison, where a label has one block or many and a group of near copies is dense."""
    from dwellgraph.llm import embedding_dedup as e

    monkeypatch.setattr(e, "BLOCK", block)
    monkeypatch.setattr(e, "PRODUCTS", 500)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 24))
    noise = rng.normal(size=(260, 24)) * rng.choice([0.01, 0.2, 0.35], (260, 1))
    x = np.concatenate([centres, centres[rng.integers(0, 60, 200)] + noise[:200], centres[0] + noise[200:] * 0.1]).astype(np.float32)
    label = (np.arange(len(x)) % 7 == 0).astype(int)
    label[260:] = 0
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))] + [(900, x[0].tolist(), 0), (901, [1.0, 2.0], 0), (902, None, 0)]
    got = {r.vec_id: r for r in e.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "1 block", "2 point")).collect()}
    ids = [r[0] for r in rows[:-2]]
    every, k = np.array([r[1] for r in rows[:-2]], np.float32).astype(float), np.array([r[2] for r in rows[:-2]])
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    near = (unit @ unit.T >= e.COSINE) & (k[:, None] == k[None, :])
    np.fill_diagonal(near, False)
    want = components([(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)], ids)
    assert {i: (got[i].n_links, got[i].component_id) for i in ids} == {i: (int(near[n].sum()), want[i]) for n, i in enumerate(ids)}
    assert got[901].n_links == got[902].n_links == 0 and len(got) == len(rows)


def test_cover_tree_keeps_its_radii():
    from dwellgraph.llm.embedding_dedup import CoverTree

    rng = np.random.default_rng(10)
    x = rng.normal(size=(300, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = CoverTree(x, 0.05)
    depth, stack = {0: 0}, [0]
    while stack:
        p = stack.pop()
        assert tree.radius[p] <= 2.0 / 2 ** depth[p] + 1e-9 and tree.centre[p] in tree.members[p]
        if tree.children[p]:
            assert sorted(np.concatenate([tree.members[c] for c in tree.children[p]])) == sorted(tree.members[p])
            assert tree.centre[tree.children[p][0]] == tree.centre[p]
        for c in tree.children[p]:
            depth[c] = depth[p] + 1
            stack.append(c)
    assert max(depth.values()) >= 4


def test_licence_versions_are_told_apart(spark):
    """Each template states its own licence and no other, also among prose, in capitals, twice, and as paragraphs."""
    from dwellgraph.llm.licenses import TEMPLATES, scan

    want, rows = {}, []
    for name, texts in TEMPLATES.items():
        for k, t in enumerate(texts):
            i = len(rows)
            rows.append((i, [t, f"some prose of the work\n{t.upper()}\nmore of it\n{t}", f"first\n\n{t}\n\nlast words of a paragraph"][k % 3]))
            want[i] = {name}
    rows += [(900, "licensed under nothing in particular, " * 3000), (901, None), (902, ""), (903, "word")]
    got = {}
    for r in scan(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert got == want
    assert scan(docs(spark, [])).count() == 0
