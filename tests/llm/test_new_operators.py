"""Sharding, whitening and alignment against plain versions, and on odd inputs."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

ODD = [(1, None), (2, ""), (3, None), (4, "same"), (4, "same"), (None, "same"), (5, "é" * 500), (6, "x" * 200_000), (7, " lead"), (8, "tab\there\nand  two "), (9, "語" * 3000)]
DOCS = "doc_id bigint, text string, shard int, size string, pairs int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 9, "z", None) for i, t in rows], DOCS)


def smallest_capacity(sizes, shards):
    """By trying all cuts, with a table."""
    sums = [0, *itertools.accumulate(sizes)]
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [min(max(best[i], sums[j] - sums[i]) for i in range(j + 1)) for j in range(len(sums))]
    return best[-1]


@pytest.mark.parametrize("hot", [0, 60])
@pytest.mark.parametrize("first", [1, 12])
def test_shards_equal_all_cuts(spark, monkeypatch, hot, first):
    from dwellgraph.llm import sharding

    monkeypatch.setattr(sharding, "FIRST", first)
    rng = random.Random(hot)
    rows = [(i, "".join(rng.choice("abc é") for _ in range(rng.choice([0, 3, 30, 200])))) for i in range(150)]
    rows += [(1000 + i, "one text of a large group of copies") for i in range(hot)] + ODD
    rows = [(i, t) for i, t in rows if hot or t is None or len(t) < 1000]
    got = sharding.assign(frame(spark, rows), 5).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i is None, i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    of_text = {}
    for r in got:
        of_text.setdefault((r.size, r.text_crc32), set()).add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 5
    assert all(len(s) == 1 for s in of_text.values())
    for k in range(5):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    hashed = {r.t: r.g for r in frame(spark, rows).selectExpr("coalesce(text, '') t").distinct().select("t", sharding.group_of(sharding.F.col("t")).alias("g")).collect()}
    sizes = Counter()
    for _, t in rows:
        sizes[hashed[t or ""]] += len((t or "").encode()) + 1
    order, shards = [sizes[g] for g in sorted(sizes)], 5
    largest = []
    while shards > 1 and max(order) * shards > sum(order):
        largest.append(max(order))
        order.remove(largest[-1])
        shards -= 1
    want = max([*largest, smallest_capacity(order, shards)])
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    assert max(load.values()) == want
    assert not largest or largest[0] == load[0]


def test_shards_are_even_and_written(spark, tmp_path):
    from dwellgraph.llm import sharding

    rows = [(i, hashlib.sha256(str(i).encode()).hexdigest() * (1 + i % 7)) for i in range(3000)]
    load = Counter()
    for r in sharding.assign(frame(spark, rows)).collect():
        load[r.shard] += r.size
    mean = sum(load.values()) / 16
    assert len(load) == 16 and all(abs(v - mean) < 0.01 * mean for v in load.values())
    written = sharding.write_shards(frame(spark, rows), str(tmp_path / "out"))
    assert written.columns == ["doc_id", "text", "shard", "size", "pairs", "shard_"] and written.count() == 3000
    again = Counter()
    for r in written.selectExpr("shard_ s", "octet_length(text) + 1 n").collect():
        again[r.s] += r.n
    assert again == load


def test_shards_of_few_rows(spark):
    from dwellgraph.llm import sharding

    assert sharding.assign(frame(spark, [])).count() == 0
    one = sharding.assign(frame(spark, [(7, None)])).collect()
    assert [(r.doc_id, r.size, r.text_crc32, r.slot) for r in one] == [(7, 1, 0, 0)]
    copies = sharding.assign(frame(spark, [(7, "a"), (7, "a"), (8, "b")]), 2).collect()
    assert sorted((r.doc_id, r.slot) for r in copies) == [(7, 0), (7, 1), (8, 0)]


VECTORS = "vec_id bigint, embedding array<float>, label int, n string, state int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "n", 0) for i, v in rows], VECTORS)


def test_whitening_equals_numpy(spark):
    from dwellgraph.llm.whitening import whitened_rows

    rng = np.random.default_rng(3)
    made = (rng.normal(size=(700, 11)) @ rng.normal(size=(11, 11)) + 5).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(made)] + [(900, made[0].tolist()), (0, made[0].tolist())]
    odd = [(800, None), (801, [None] + [0.0] * 10), (802, [float("nan")] * 11), (803, [float("inf")] * 11), (804, [1.0]), (805, []), (806, [3e38] * 11)]
    got = whitened_rows(vectors(spark, rows + odd).repartition(5)).collect()
    x = np.floor(np.array([v for _, v in rows], np.float64) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    assert len(got) == 8 * n and {r.vec_id for r in got} == {i for i, _ in rows} and {r.n for r in got} == {n}
    values, columns = np.linalg.eigh(np.cov(x.T, bias=True))
    values, columns = values[::-1], columns[:, ::-1]
    exact = {i: sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for (i, _), row in zip(rows, x)}
    white = {i: (row - sums / n) @ columns / np.sqrt(values) for (i, _), row in zip(rows, x)}
    signs = {}
    for r in got:
        assert r.deviation == exact[r.vec_id]
        want = white[r.vec_id][r.component - 1]
        signs.setdefault(r.component, np.sign(r.whitened) * np.sign(want))
        assert abs(r.whitened - signs[r.component] * want) < 1e-8
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-12 and r.identity_error < 1e-9


def test_whitening_of_few_and_flat_vectors(spark):
    from dwellgraph.llm.whitening import whitened_rows

    assert whitened_rows(vectors(spark, [])).count() == 0 and whitened_rows(vectors(spark, [(1, None), (2, [])])).count() == 0
    flat = whitened_rows(vectors(spark, [(None, [1.0, 2.0]), (2, [1.0, 4.0]), (2, [1.0, 4.0])])).collect()
    assert len(flat) == 6 and all((r.whitened is None) == (r.component == 2) for r in flat) and {r.vec_id for r in flat} == {None, 2}
    alone = whitened_rows(vectors(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.component, r.whitened, r.deviation, r.explained, r.identity_error) for r in alone] == [(1, None, 0, None, None), (2, None, 0, None, None)]


def test_moments_of_far_values_are_exact(spark):
    from dwellgraph.llm.whitening import Moments, Whitening, merged, moments

    x = np.array([[2**49, 1], [2**49 - 7, 5], [3, 9]])
    parts = merged(merged(moments(x[:1]), Moments(0, None, np.zeros(2), np.zeros((2, 2)))), moments(x[1:]))
    assert parts.sums == [2**50 - 4, 15] and np.allclose(parts.scatter, np.cov(x.T, bias=True) * 3)
    model = Whitening(3, tuple(parts.sums), np.ones(2), np.eye(2), 2.0)
    assert model.apply(x, 2)[0] == [sum((3 * int(a) - s) ** 2 for a, s in zip(r, parts.sums)) for r in x]


@pytest.fixture(scope="module")
def pair():
    pytest.importorskip("public_tokenizers")
    from dwellgraph.llm.alignment import public_pair

    return public_pair()


def plain_alignment(codec, text):
    """Groups and links of a text by intervals, with both libraries on the whole text."""
    from dwellgraph.llm.alignment import first_kind_bytes, second_kind_bytes

    if not text:
        return [], [], "", [], 0
    a = codec.first.encode(" " + text, add_special_tokens=False).ids
    b = codec.second.encode(text)
    spelled = (" " + text).encode()
    bytes_a = [first_kind_bytes(codec.first.id_to_token(i)) for i in a]
    bytes_b = [second_kind_bytes(codec.second.id_to_piece(i)) for i in b]
    if b"".join(bytes_a) != spelled or b"".join(bytes_b) != spelled:
        return [], [], "", [], 0
    spans = lambda parts: list(itertools.pairwise([0, *itertools.accumulate(map(len, parts))]))
    at_a, at_b = spans(bytes_a), spans(bytes_b)
    shared = sorted({e for _, e in at_a} & {e for _, e in at_b})
    groups, low = [], 0
    for cut in shared:
        groups.append(",".join(str(i) for i, (_, e) in zip(a, at_a) if low < e <= cut) + "|" + ",".join(str(i) for i, (_, e) in zip(b, at_b) if low < e <= cut))
        low = cut
    links = [(i, j) for i, (s, e) in zip(a, at_a) for j, (t, f) in zip(b, at_b) if max(s, t) < min(e, f)]
    return a, b, ";".join(groups), links, len(shared)


def some_texts():
    rng = random.Random(5)
    parts = ["house", " ", "  ", "\n", "ö", "語", "🙂", "42", "'s", "<|endoftext|>", "</s>", " ", "foo_bar", "ﬁ", "́", "don't", ".", "Übermut", "\r\n", "　", "ชื่อ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(120)] + ["a▁b", "one two", "▁", "x▁ y", "\x00", "a\x85b", "word " * 40]


@pytest.mark.parametrize("hot", [1 << 19, 10])
def test_alignment_equals_intervals(spark, pair, hot):
    from dwellgraph.llm.alignment import Codec, alignment_digests

    codec = Codec(*pair)
    rows = [(i, t[:400] if t else t) for i, t in enumerate(some_texts())] + [(i and i + 500, t[:300] if t else t) for i, t in ODD]
    want = [(i, plain_alignment(codec, t)) for i, t in rows]
    counts = Counter(link for _, w in want for link in w[3])
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    expected = Counter()
    for i, (a, b, groups, links, n) in want:
        digest = hashlib.sha256(groups.encode()).hexdigest() if a else ""
        expected[i, len(a), len(b), n, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), digest] += 1
    got = Counter(tuple(r) for r in alignment_digests(frame(spark, rows), *pair, hot=hot).collect())
    assert got == expected and sum(1 for _, w in want if w[0]) > 60


def test_pieces_encode_as_whole_texts(pair):
    """Encoding in pieces gives the ids of the whole text, however its white space lies."""
    from dwellgraph.llm.alignment import Codec

    codec = Codec(*pair)
    assert codec.cuts
    for text in [*some_texts(), "x" * 5000, "ab  cd\t e\n f " * 30]:
        ids, a, b = codec.encode(text), *plain_alignment(codec, text)[:2]
        assert (ids is None) == (not a) and (ids is None or (ids[0].tolist(), ids[1].tolist()) == (a, b))


def test_groups_are_told_and_long_texts_are_linear(spark, pair):
    import time

    from dwellgraph.llm.alignment import align_documents

    long = "Some words and 語語 more of them, " * 40_000
    began = time.time()
    rows = align_documents(frame(spark, [(1, "one house"), (2, long), (3, None)]), *pair, with_groups=True).collect()
    assert time.time() - began < 60
    of = {r.doc_id: r for r in rows}
    assert of[1].groups.count("|") == of[1].n_groups and of[3].groups == "" and of[2].n_links >= of[2].n_a > 400_000
    assert align_documents(frame(spark, []), *pair).count() == 0
