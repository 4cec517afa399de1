"""A keyed table that grows by batches: a batch counts once, a failed one not at all, and every version can be read."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MANIFEST = "version bigint, batch string, kind string, folder string, at timestamp"
_GONE = "_gone"


@dataclass(frozen=True)
class VersionedTable:
    """Rows by keys in a folder of the shared store: a base and the batches since, listed by a manifest.

    A batch writes its own rows only, into a folder of its own, and then one row of the manifest, which
    makes them count: a batch that fails half way leaves a folder that nothing names, and is applied again
    in whole. A batch known to the manifest is passed over, so a replay gives the same table. Reading takes
    the last row of each key from the batches and the rest from the base; compact() makes a new base of both.
    One writer at a time: two that claim one version collide, and the later fails.
    """

    spark: SparkSession
    path: str
    schema: StructType
    keys: tuple[str, ...]

    def manifest(self) -> list:
        """The versions so far, in order."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not folder.getFileSystem(self.spark._jsc.sc().hadoopConfiguration()).exists(folder):
            return []
        rows = self.spark.read.schema(_MANIFEST).option("recursiveFileLookup", "true").parquet(f"{self.path}/manifest").collect()
        return sorted(rows, key=lambda r: r.version)

    def _commit(self, kind: str, batch: str, folder: str) -> int:
        version = max((r.version for r in self.manifest()), default=0) + 1
        row = self.spark.createDataFrame([(version, batch, kind, folder)], "version bigint, batch string, kind string, folder string").withColumn("at", F.current_timestamp())
        row.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifest/{version:012d}")
        return version

    def _write(self, rows: DataFrame, kind: str, batch: str) -> int:
        folder = f"data/{kind}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return self._commit(kind, batch, folder)

    def apply(self, batch: str, rows: DataFrame, *, deleted: DataFrame | None = None, order: list[str] | None = None) -> int:
        """Put the rows in the place of those with their keys, or add them, and take the deleted keys out; returns the version.

        Of rows that repeat a key the last by order counts; without an order a repeated key is an error, as is a null one.
        """
        known = {r.batch: r.version for r in self.manifest()}
        if batch in known:
            return known[batch]
        keyed = Window.partitionBy(*self.keys)
        rows = rows.select(*self.schema.names)
        if order:
            place = F.row_number().over(keyed.orderBy(*[F.desc(c) for c in order]))
            rows = rows.withColumn("_n", place).where("_n = 1").drop("_n")
        else:
            rows = rows.withColumn("_n", F.count("*").over(keyed))
            rows = rows.where(F.when(F.col("_n") > 1, F.raise_error(F.lit("a batch repeats a key"))).otherwise(F.lit(True))).drop("_n")
        whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in self.keys])
        rows = rows.where(F.when(whole, True).otherwise(F.raise_error(F.lit("a batch has a null key")).cast("boolean"))).withColumn(_GONE, F.lit(False))
        if deleted is not None:
            gone = deleted.select(*self.keys).distinct().join(rows.select(*self.keys), list(self.keys), "left_anti")
            rows = rows.unionByName(gone.withColumn(_GONE, F.lit(True)), allowMissingColumns=True)
        return self._write(rows, "batch", batch)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the newest if not given; before the first one it is empty."""
        listed = [r for r in self.manifest() if version is None or r.version <= version]
        at = max((i for i, r in enumerate(listed) if r.kind == "base"), default=-1)
        base = self.spark.read.schema(self.schema).parquet(f"{self.path}/{listed[at].folder}") if at >= 0 else self.spark.createDataFrame([], self.schema)
        since = listed[at + 1 :]
        if not since:
            return base
        marked = StructType([*self.schema.fields]).add(_GONE, "boolean")
        rows = reduce(DataFrame.unionByName, [self.spark.read.schema(marked).parquet(f"{self.path}/{r.folder}").withColumn("_v", F.lit(r.version)) for r in since])
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*[c for c in [*self.schema.names, _GONE] if c not in self.keys]), "_v").alias("_row"))
        new = last.where(f"not _row.{_GONE}").select(*[F.col(c) if c in self.keys else F.col("_row")[c].alias(c) for c in self.schema.names])
        return base.join(rows.select(*self.keys).distinct(), list(self.keys), "left_anti").select(*self.schema.names).unionByName(new)

    def compact(self) -> int:
        """Write the newest version as a new base; what readers see stays the same, and old versions can still be read."""
        return self._write(self.read(), "base", f"base-{uuid.uuid4().hex}")

    def sink(self, stream: DataFrame, checkpoint: str, *, order: list[str]) -> None:
        """Apply each micro-batch of a stream under its number, until all that is there is done: exactly once, with restarts."""
        put = lambda batch, number: self.apply(f"stream-{number}", batch, order=order)
        stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
