"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import time
import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder that holds the package; Python workers need it on their path.
ROOT = str(Path(__file__).resolve().parents[2])

#: A side is broadcast only if it was counted and has at most so many rows and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package where the driver found it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a new temporary one only where the driver runs the tasks too, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and reread it: lineage ends there, and it outlives executors."""
    path = fresh_path(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, tag: str, by: str, codec: str = "snappy") -> DataFrame:
    """As materialize, in as many buckets of a column as a shuffle has partitions: what joins or groups by it doesn't shuffle the table again."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    name = path.rpartition("/")[2].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", codec).option("path", path).bucketBy(buckets, by).saveAsTable(name, format="parquet")
    table = spark.table(name)
    # The files are not the catalogue's, and the table that was looked up goes on reading them.
    spark.sql(f"drop table {name}")
    return table


def discard(*tables: DataFrame) -> None:
    """Give back the disk of tables that materialize wrote and that nothing reads any more: an empty one replaces each."""
    for df in tables:
        if files := df.inputFiles():
            df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(files[0].rpartition("/")[0])


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished jobs: it waits until the driver has forgotten their plans.

    The plans of the last job are let go a moment after it has ended, hence the second round.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def fresh_name(wish: str, *frames: DataFrame) -> str:
    """A column name that none of the tables has, in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if the (materialised) table was measured small, in rows and in bytes; else the plan shuffles."""
    wide = [F.octet_length(f"`{c}`") for c, t in df.dtypes if t in ("string", "binary")] + [8 * F.greatest(F.size(f"`{c}`"), F.lit(0)) for c, t in df.dtypes if t.startswith("array")]
    flat = F.lit(8 * (2 + len(df.columns))).cast("bigint")
    found = df.agg(F.count("*").alias("n"), F.sum(sum((F.coalesce(w, F.lit(0)) for w in wide), flat)).alias("bytes")).first()
    return F.broadcast(df) if found["n"] <= rows and (found["bytes"] or 0) <= size else df


def broadcaster(count: int, rows: int = BROADCAST_ROWS) -> Callable[[DataFrame], DataFrame]:
    """A broadcast hint for tables of a few numbers a row and at most the counted rows if those are few; else no hint."""
    return F.broadcast if count <= rows else lambda df: df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift) over an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit hashes of words, kept for the words met so far up to a bound of entries."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_HELD: dict = {}


def held[T](key: object, make: Callable[[], T]) -> T:
    """What the worker keeps between tasks under a key, made when first asked for.

    Workers serve one operator after another; what another key had is let go, so they keep the memory of one.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The hashes of words, by the one table of words that all operators of a worker share."""
    return held("words", WordHashes).array(words)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of n words, in order; a shorter non-empty sequence is one shingle."""
    if not len(words):
        return words
    n_eff = min(n, len(words))
    out = np.full(len(words) - n_eff + 1, np.uint64(len(words) if n_eff < n else n), np.uint64)
    for i in range(n_eff):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n_eff + 1 + i])
    return out


def ascii_words(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


_PLAIN = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """The lower-cased text's runs of ASCII letters and digits and of other than ASCII, as UTF-8."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()
