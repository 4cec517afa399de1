"""Streaming forms: deduplication, change capture, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, keys: list[str], *, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once within the time that rows may be late; state ends with the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, keys: list[str], width: str, *, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Counts and sums of value for each key and window."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(stream: DataFrame, key: str, gap: str, *, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Sessions of a key: their start, end and number of rows."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def run_once(stream: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> None:
    """Write all that is there now as Parquet and stop."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(path).awaitTermination()

def refresh_on_change(stream: DataFrame, refresh, checkpoint: str) -> None:
    """Hand each micro-batch's changed keys, once each, to refresh(keys, batch_id), and stop when all that is there is done.

    The batch id makes a repeated hand-over after a failure known to refresh. The stream has a column id.
    """
    hand_over = lambda batch, number: refresh(batch.select("id").distinct(), number)
    stream.writeStream.foreachBatch(hand_over).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
