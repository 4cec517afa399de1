"""Near-duplicate documents by a chosen-path set similarity join over word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgraph.llm.common import ascii_words, broadcast_if_small, fresh_name, materialize, mix, prepare, shingle_hashes, word_hashes
from dwellgraph.llm.paths import link

#: Minwise values kept for each document.
COORDINATES = 64
#: Independent trees, paths chosen at each root, and tokens that a path takes before its buckets are compared.
TREES, ROOTS, FIRST_DEPTH = 6, 2, 3
#: Independent paths that a class takes on below a node that is branched, and tokens that each takes.
CHILDREN, STEP = 8, 2
#: Words of 64 parities in the sketch of a set.
SKETCH = 32

_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of n words; of a shorter text, of its whole sequence."""
    return np.unique(shingle_hashes(word_hashes(ascii_words(text)), n))


def set_id(shingles: np.ndarray) -> int:
    import xxhash

    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()))))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minwise value of the set for each seed, as 32 bits."""
    low = np.full(COORDINATES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(shingles), 2048):
        np.minimum(low, (shingles[i : i + 2048, None] * _SEEDS).min(axis=0), out=low)
    return (mix(low) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def document_sets(docs: DataFrame, *, words: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, cid, sig) of every row; cid names the set, null for a text without words."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cids, sigs = [], [], []
            for i in range(batch.num_rows):
                found = shingle_set(batch.column(1)[i].as_py(), words)
                n.append(len(found))
                cids.append(set_id(found) if len(found) else None)
                sigs.append(signature(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cids, pa.int64()), pa.array(sigs, pa.list_(pa.int32()))], [key, "n_shingles", "cid", "sig"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_shingles bigint, cid bigint, sig array<int>")


def _packed(docs: DataFrame, wanted: DataFrame, *, words: int, text: str, key: str) -> DataFrame:
    """(cid, packed) of the wanted (cid, rep): the sorted shingles of the document that stands for the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i in range(batch.num_rows):
                found = shingle_set(batch.column(1)[i].as_py(), words)
                if set_id(found) == (cid := batch.column(0)[i].as_py()):  # a repeated key may stand for other texts
                    ids.append(cid)
                    out.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["cid", "packed"])

    rows = docs.select(F.col(key).alias("rep"), F.col(text).alias("text_of")).join(broadcast_if_small(wanted), "rep")
    return rows.select("cid", "text_of").mapInArrow(run, "cid bigint, packed binary").dropDuplicates(["cid"])


def _confirmed(pairs: DataFrame, packed: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                short, long = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(long, short)
                both = int(np.count_nonzero(long[np.minimum(at, len(long) - 1)] == short))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    sides = pairs.join(packed.select(F.col("cid").alias("b"), F.col("packed").alias("y")), "b").join(packed.select(F.col("cid").alias("a"), F.col("packed").alias("x")), "a")
    return sides.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _sketches(packed: DataFrame) -> DataFrame:
    """(id, n, b0, ...) of (cid, packed) rows: the size of the set and the parities of its elements in SKETCH * 64 cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, bits = np.empty(batch.num_rows, np.int64), np.empty((batch.num_rows, SKETCH), np.int64)
            for i in range(batch.num_rows):
                found = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint64)
                cells = (found & np.uint64(64 * SKETCH - 1)).astype(np.int64)
                n[i] = len(found)
                bits[i] = np.packbits((np.bincount(cells, minlength=64 * SKETCH) & 1).astype(bool)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *[pa.array(bits[:, w].copy()) for w in range(SKETCH)]], ["id", "n", *[f"b{w}" for w in range(SKETCH)]])

    return packed.select("cid", "packed").mapInArrow(run, ", ".join(["id bigint", "n bigint", *[f"b{w} bigint" for w in range(SKETCH)]]))


def _step(node, seed: int):
    """The node below a node: the minwise token at the coordinate that the node selects."""
    at = F.pmod(F.xxhash64(node, F.lit(seed)), F.lit(COORDINATES)).cast("int")
    return F.xxhash64(node, at, F.col("sig")[at])


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id", trees: int = TREES) -> DataFrame:
    """Classes of documents linked by 100 * intersection >= percent * union of their word shingles.

    Returns one row per input row: key, n_shingles (the size of its set), component_id (the smallest key
    reachable by links, its own included) and kept (key = component_id). Words are runs of other than
    ASCII white space with A-Z lower-cased; a text of fewer words than a shingle is one shingle; null and
    empty texts have no shingles, link with nothing and are kept. A null key is never a component's name;
    a row with a null key is kept only if it links with nothing, and then its component is null.
    Repeated keys are as many rows. Other columns are not looked at; an empty table gives no rows.

    Documents with equal sets become one class first, so exact copies cost one comparison at most. Each
    class walks down independent trees: a node selects a coordinate, and the class goes to the child
    named by its minwise token there. Nodes are compared on whole sets, the large ones as paths.link says. Documents with similarity s meet on a path with s ** FIRST_DEPTH, so the
    trees together find a pair at 0.85 with 0.99999 and one at 0.8 with 0.9998. Below a node that has to be
    branched a class takes CHILDREN independent paths of STEP tokens, of which the pair shares one with
    1 - (1 - s ** STEP) ** CHILDREN: 0.99996 at 0.85 and 0.9997 at 0.8, for each of two levels at most and
    each node that it shares, so that these figures hold in wide nodes too (0.9999 and 0.9997 at least).
    """
    sets = materialize(document_sets(docs, words=words, text=text, key=key), "sets")
    full = sets.where("cid is not null")
    classes = materialize(full.groupBy("cid").agg(F.min(key).alias("rep")), "classes")
    sigs = materialize(full.select("cid", "sig").dropDuplicates(["cid"]), "sigs")

    rows = sigs.select(F.col("cid").alias("id"), "sig", F.explode(F.array(*[F.lit(i) for i in range(trees * ROOTS)])).alias("root"))
    node = F.xxhash64("root", F.lit(words))
    for seed in range(FIRST_DEPTH):
        rows = rows.withColumn("node", _step(node, seed))
        node = F.col("node")

    packed: list[DataFrame] = []

    def branch(wide: DataFrame, level: int) -> DataFrame:
        wide = wide.join(sigs.withColumnRenamed("cid", "id"), "id")
        wide = wide.withColumn("node", F.explode(F.array(*[F.xxhash64("node", F.lit(f"child {i}")) for i in range(CHILDREN)])))
        for seed in range(STEP):
            wide = wide.withColumn("node", _step(F.col("node"), FIRST_DEPTH + STEP * (level - 1) + seed))
        return wide.select("node", "id")

    def verify(pairs: DataFrame) -> DataFrame:
        if not packed:  # the first pairs hold every set that shares a bucket
            ids = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
            wanted = materialize(classes.join(ids, "cid").where("rep is not null"), "wanted")
            packed.append(materialize(_packed(docs, wanted, words=words, text=text, key=key), "packed"))
        return _confirmed(pairs, packed[0], percent)

    def sketch(ids: DataFrame) -> DataFrame:
        return _sketches(packed[0].join(ids.withColumnRenamed("id", "cid"), "cid", "left_semi"))

    def may(x: str, y: str) -> Column:
        # Such sets differ in at most (100 - percent) / (100 + percent) of the sum of their sizes, and the
        # elements that differ account for each parity that does, so no pair that reaches percent is lost.
        n, m = F.col(f"{x}n"), F.col(f"{y}n")
        apart = sum((F.bit_count(F.col(f"{x}b{w}").bitwiseXOR(F.col(f"{y}b{w}"))) for w in range(SKETCH)), F.lit(0))
        return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * apart <= (100 - percent) * (n + m))

    labels = link([rows.select("node", "id")], branch, verify, (sketch, may))
    named = classes.join(labels.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component_id", "cid"))
    named = materialize(named.select("cid", "rep", "component"), "named")
    least = materialize(named.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    of_set = materialize(named.join(broadcast_if_small(least), "component").select("cid", "component_id"), "of_set")
    out = sets.select(key, "n_shingles", "cid").join(broadcast_if_small(of_set), "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col(key)).otherwise(F.col("component_id"))
    return out.select(key, "n_shingles", component.alias("component_id"), F.coalesce(F.col(key) == component, component.isNull()).alias("kept"))


def first_of_each(docs: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """The documents that are kept, one of each component, all their columns unchanged; rows with a null key stay."""
    found = near_duplicates(docs, key=key, **options)
    name = fresh_name("gone", docs)
    gone = materialize(found.where(~F.col("kept") & F.col(key).isNotNull()).select(F.col(key).alias(name)).distinct(), "gone")
    return docs.join(broadcast_if_small(gone), F.col(key) == F.col(name), "left_anti")
