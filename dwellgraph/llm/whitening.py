"""Whitening of embeddings by merged moments: each partition's count, mean and centred scatter, merged pairwise."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgraph.llm.common import prepare

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries whose whole number would be as large count as not finite: below it, it is exact.
LIMIT = 2.0**50
#: Components of the query.
COMPONENTS = 8


@dataclass
class Moments:
    """n vectors' sums (whole numbers, exact), mean and scatter around the mean."""

    n: int
    sums: list[int] | None
    mean: np.ndarray
    scatter: np.ndarray


def moments(x: np.ndarray) -> Moments:
    """Of the rows of a matrix; sums are made for whole numbers only. Centred before multiplying."""
    n, d = x.shape
    if not n:
        return Moments(0, None, np.zeros(d), np.zeros((d, d)))
    sums = [int(s) for s in x.sum(axis=0, dtype=np.int64)] if x.dtype.kind == "i" else None
    x = x.astype(np.float64, copy=False)
    # A mean may be off by its own rounding; the scatter is mended for it.
    mean = x.mean(axis=0)
    apart = x - mean
    off = apart.mean(axis=0)
    return Moments(n, sums, mean + off, apart.T @ apart - n * np.outer(off, off))


def merged(a: Moments, b: Moments) -> Moments:
    """Of the rows of both, by the pairwise formula."""
    if not a.n or not b.n:
        return b if b.n else a
    n, apart = a.n + b.n, b.mean - a.mean
    sums = [x + y for x, y in zip(a.sums, b.sums, strict=True)] if a.sums is not None and b.sums is not None else None
    return Moments(n, sums, a.mean + apart * (b.n / n), a.scatter + b.scatter + np.outer(apart, apart) * (a.n * b.n / n))


def whole_numbers(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, x): the places of the usable vectors of dims entries, and their whole numbers."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    places = np.flatnonzero((lengths == dims) & column.is_valid().to_numpy(zero_copy_only=False))
    values = flat[starts[places][:, None] + np.arange(dims)] if len(places) else np.empty((0, dims))
    good = (np.abs(values) * SCALE < LIMIT).all(axis=1)  # not so for NaN, which a null entry is too
    return places[good], np.floor(values[good] * SCALE).astype(np.int64) + SHIFT


def _total(states: DataFrame, dims: int) -> Moments:
    """The merged moments of a table of pickled ones, by a tree of merges."""
    spark = states.sparkSession
    none = spark.sparkContext.parallelize([pickle.dumps(Moments(0, None, np.zeros(dims), np.zeros((dims, dims))))], 1)
    load = lambda s: pickle.loads(bytes(s))  # noqa: E731, S301
    return none.union(states.rdd.map(lambda r: bytes(r.state))).map(load).treeReduce(merged, depth=3)


def _states(batches: Iterator[pa.RecordBatch], dims: int, read) -> Iterator[pa.RecordBatch]:
    total = Moments(0, None, np.zeros(dims), np.zeros((dims, dims)))
    for batch in batches:
        # Few rows at once: a wide batch isn't held twice.
        for lo in range(0, batch.num_rows, 4096):
            total = merged(total, moments(read(batch.slice(lo, 4096))))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["state"])


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: vectors of n rows, their sums, and the components by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def rank(self) -> int:
        """Components whose eigenvalue is more than the noise of the sums."""
        return int((self.values > self.dims * np.finfo(float).eps * max(self.values.max(initial=0), 0)).sum())

    def explained(self, component: int) -> float | None:
        return max(float(self.values[component]), 0.0) / self.trace if self.trace > 0 else None

    def apply(self, x: np.ndarray, components: int) -> tuple[list[int], np.ndarray]:
        """(deviations, whitened) of whole-number vectors; NaN where the eigenvalue is 0."""
        n, sums = self.n, np.array(self.sums, object)
        most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, self.sums), default=0)) * 2
        if most < 2**62:
            centred = x * np.int64(n) - sums.astype(np.int64)
            largest = int(np.abs(centred).max(initial=0))
            deviation = (centred**2).sum(axis=1).tolist() if largest**2 * max(1, self.dims) < 2**62 else (centred.astype(object) ** 2).sum(axis=1).tolist()
        else:
            centred = x.astype(object) * n - sums
            deviation = (centred**2).sum(axis=1).tolist()
        apart = centred.astype(np.float64) / n
        k, rank = min(components, self.dims), self.rank
        scale = np.array([1 / np.sqrt(self.values[j]) if j < rank else np.nan for j in range(k)])
        return deviation, (apart @ self.vectors[:, :k]) * scale


def dims_of(vectors: DataFrame, vector: str) -> int:
    """The length that most vectors have; of equally frequent ones the greater. 0 if there are none."""
    found = vectors.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count().agg(F.max_by("d", F.struct("count", "d")).alias("d")).first()
    return found.d or 0


def fit(vectors: DataFrame, *, vector: str = "embedding", dims: int | None = None) -> Whitening | None:
    """The whitening of all usable vectors; None if there are none.

    Usable are vectors of dims entries (of the most frequent length if not given), all known and finite.
    Each partition makes its moments, a tree of tasks merges them; a table of moments has dims^2 numbers a
    partition, and only the last few come to the driver, which takes the eigenvectors.
    """
    prepare(vectors.sparkSession)
    dims = dims or dims_of(vectors, vector)
    if not dims:
        return None
    states = vectors.select(vector).mapInArrow(lambda b: _states(b, dims, lambda x: whole_numbers(x.column(0), dims)[1]), "state binary")
    total = _total(states, dims)
    if not total.n:
        return None
    values, columns = np.linalg.eigh((total.scatter + total.scatter.T) / (2 * total.n))
    values, columns = values[::-1], columns[:, ::-1]
    # Of either sign the one whose largest entry is positive.
    columns = columns * np.sign(columns[np.abs(columns).argmax(axis=0), np.arange(dims)])
    return Whitening(total.n, tuple(total.sums), values, columns, float(np.trace(total.scatter) / total.n))


def whiten(vectors: DataFrame, model: Whitening, *, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(key, deviation, whitened) of each usable vector, in the order in which they come.

    deviation is the exact sum of (n * x - S)^2 over the dimensions, as a decimal. whitened has an entry for each
    component up to the number of dimensions, null where the eigenvalue is 0 (the fit's vectors all lie in a
    plane across it). Rows without a usable vector are left out; repeated rows and null keys are kept; other
    columns are not looked at.
    """
    prepare(vectors.sparkSession)
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        model = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                places, x = whole_numbers(part.column(1), model.dims)
                deviation, white = model.apply(x, components)
                k = white.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(places) + 1, dtype=np.int32) * k), pa.array(white.ravel(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(places)), pa.array([Decimal(v) for v in deviation], pa.decimal128(38, 0)), lists], [key, "deviation", "whitened"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, vector).mapInArrow(run, f"`{key}` {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(white: DataFrame, components: int, *, whitened: str = "whitened") -> float | None:
    """The largest absolute entry of the whitened rows' covariance less the identity, over the first components, by a pass of its own."""
    if not components:
        return None

    def read(part: pa.RecordBatch) -> np.ndarray:
        flat = part.column(0).flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(part.num_rows, -1)[:, :components] if part.num_rows else np.empty((0, components))

    total = _total(white.select(whitened).mapInArrow(lambda b: _states(b, components, read), "state binary"), components)
    return float(np.abs(total.scatter / total.n - np.eye(components)).max()) if total.n else None


def whitened_rows(vectors: DataFrame, *, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of each usable vector and component.

    Fit, verify and project are three passes over the vectors. A deviation beyond a long is null. An empty table,
    or one without usable vectors, gives no rows; vectors of a length other than the most frequent are left
    out; see whiten for nulls and repeated rows.
    """
    kind = vectors.schema[key].dataType.simpleString()
    model = fit(vectors, vector=vector)
    if model is None:
        return vectors.sparkSession.createDataFrame([], f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    white = whiten(vectors, model, vector=vector, key=key, components=components)
    error = identity_error(white, min(components, model.rank))
    explained = F.array(*[F.lit(model.explained(j)).cast("double") for j in range(min(components, model.dims))])
    rows = white.select(F.col(key), F.expr("try_cast(deviation as bigint)").alias("deviation"), F.posexplode("whitened").alias("place", "whitened"))
    return rows.select(key, (F.col("place") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", F.get(explained, F.col("place")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
