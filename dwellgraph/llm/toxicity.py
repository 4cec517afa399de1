"""Toxicity scores: logistic regression over hashed word n-grams and skip-grams, learned by FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgraph.llm.common import broadcast_if_small, mix, plain_words, prepare, word_hashes

BITS = 20
#: The fit takes about so many labelled rows and bytes of their text at most, chosen by a hash of key and text.
FIT_ROWS, FIT_BYTES = 32_000, 128 << 20
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 5.0, 0.0
THRESHOLD = 0.7


@dataclass(frozen=True)
class Weights:
    """The coordinates that L1 left, in order; compact enough to broadcast: at most 2**BITS of them."""

    index: np.ndarray
    value: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS)
        w[self.index] = self.value
        return w


def features(text: str | None) -> np.ndarray:
    """Sorted distinct coordinates of a text's words, pairs of neighbours, and pairs that skip one word."""
    words = word_hashes(plain_words(text))
    parts = [mix(words)]
    for gap in (1, 2):
        if len(words) > gap:
            parts.append(mix(words[:-gap] * np.uint64(0x9E3779B97F4A7C15) + mix(words[gap:]) + np.uint64(gap)))
    return np.unique((np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int32))


def ftrl(rows: list[tuple[np.ndarray, int]], *, epochs: int = EPOCHS) -> Weights:
    """FTRL-proximal over the rows in their order: a learning rate and an L1 shrinkage for each coordinate."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weight(at: np.ndarray) -> np.ndarray:
        raw = z[at]
        lasso = np.where(at == size, 0.0, L1)
        return np.where(np.abs(raw) <= lasso, 0.0, -(raw - np.sign(raw) * lasso) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for coordinates, label in rows:
            at = np.append(coordinates, size)
            w = weight(at)
            gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            grown = n[at] + gradient * gradient
            z[at] += gradient - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    w = weight(np.arange(size + 1))
    index = np.flatnonzero(w[:-1]).astype(np.int32)
    return Weights(index, w[index], float(w[-1]))


def fit(labelled: DataFrame, *, text: str = "text", label: str = "toxic", key: str = "doc_id", rows: int = FIT_ROWS, size: int = FIT_BYTES) -> Weights:
    """Learn from (key, text, label 0/1); rows with a null label or key are left out.

    At most about rows labelled rows with size bytes of text are used, by a hash of key and text; the
    features are made where the rows are, and one task, which holds no more than that, runs the learner.
    Without rows all weights are zero and every score is a half.
    """
    prepare(labelled.sparkSession)
    labelled = labelled.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, text, label)
    there = labelled.agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("bytes")).first()
    share = min(1.0, rows / max(1, there["n"]), size / max(1, there["bytes"] or 0))
    chosen = labelled.withColumn("order", F.xxhash64(key, text))
    if share < 1:
        chosen = chosen.where(F.pmod("order", F.lit(1 << 30)) < int(share * (1 << 30)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [features(x.as_py()).tobytes() for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column(1), batch.column(2)], ["packed", "label", "order"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(o.as_py(), p.as_py(), y.as_py()) for b in batches for p, y, o in zip(*b.columns, strict=True)]
        w = ftrl([(np.frombuffer(p, np.int32), y) for _, p, y in sorted(got)])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(w.index, -1), pa.int32()), pa.array(np.append(w.value, w.bias), pa.float64())], ["i", "w"])

    made = chosen.select(text, F.col(label).cast("int").alias("label"), "order").mapInArrow(make, "packed binary, label int, order bigint")
    table = made.repartition(1).mapInArrow(learn, "i int, w double").toArrow()
    index, value = table.column("i").to_numpy(), table.column("w").to_numpy()
    if not len(index):
        return Weights(np.empty(0, np.int32), np.empty(0), 0.0)
    return Weights(index[index >= 0], value[index >= 0], float(value[index < 0][0]))


def score(docs: DataFrame, weights: Weights, *, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a column score (0 to 1) of the whole text; a null or empty text has the score of the bias.

    The column replaces one of that name. Repeated rows and nulls in other columns are left as they are.
    """
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        dense, bias = sent.value.dense(), sent.value.bias
        sums = np.array([dense[features(t.as_py())].sum() + bias for t in texts], float)
        return pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))))

    return docs.withColumn(name, scored(F.col(text)))


def learning_rows(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "toxic", text: str = "text") -> DataFrame:
    """(key, text, label) of the labelled documents that are not held out."""
    given = labels.where(~held_out(F.col(key)) & F.col(label).isNotNull()).select(key, label)
    return docs.select(key, text).join(broadcast_if_small(given), key)


def held_out(key: Column) -> Column:
    """Whether the key's crc32 leaves 1 modulo 3; false for null."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))
