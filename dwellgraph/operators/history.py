"""Snapshots, price changes and risk signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellgraph.operators.lineage import cut


def price_events(snapshots: DataFrame, *, key: str, at: str, value: str, tie: str) -> DataFrame:
    """Each change of value between consecutive snapshots of a key: old, new, change, percent, kind.

    The first snapshot makes no event, nor does an equal or null value; percent is null after a zero.
    """
    order = Window.partitionBy(key).orderBy(at, tie)
    told = snapshots.withColumn("old", F.lag(value).over(order)).where(F.col("old").isNotNull() & F.col(value).isNotNull() & (F.col("old") != F.col(value)))
    change = F.col(value) - F.col("old")
    return told.select(key, at, tie, "old", F.col(value).alias("new"), change.alias("change"), F.round(F.try_divide(change * 100, F.col("old")), 2).alias("percent"), F.when(change > 0, "increase").otherwise("decrease").alias("kind"))


def change_signals(events: DataFrame, key: str, last: int = 10) -> DataFrame:
    """Per key over its last events: how many, the largest change, and the points for sharp (14) and frequent (8) changes."""
    order = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    recent = events.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= last)
    out = recent.groupBy(key).agg(F.count("*").alias("changes"), F.max(F.abs("percent")).alias("largest"))
    return out.withColumn("points", F.when(F.col("largest") >= 30, 14).otherwise(0) + F.when(F.col("changes") >= 3, 8).otherwise(0))


def missing_fields(listings: DataFrame, columns: list[str]) -> DataFrame:
    """(id, missing, points): min(4 + k, 12) points for k missing fields if k is 3 or more; '' is missing."""
    missing = sum((F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", 1).otherwise(0) for c in columns), F.lit(0))
    told = listings.select("id", missing.alias("missing"))
    return told.withColumn("points", F.when(F.col("missing") >= 3, F.least(F.lit(12), 4 + F.col("missing"))).otherwise(0))


def content_signals(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, points) of short (under 80 characters: 8), long (300 or more: -4) and linking (7) descriptions."""
    t = F.coalesce(F.col(text), F.lit(""))
    points = F.when(F.length(t) < 80, 8).when(F.length(t) >= 300, -4).otherwise(0) + F.when(t.rlike("https?://"), 7).otherwise(0)
    return docs.select(key, points.alias("points"))


def sparkline(rows: DataFrame, *, key: str, at: str, value: str, tie: str) -> DataFrame:
    """(key, tie, x, y) of each value in a box of 100 by 90: x by its place in time, y from 90 (least) to 15 (greatest).

    A single value stands in the middle; null values are left out.
    """
    whole = Window.partitionBy(key)
    v = F.col(value)
    told = rows.where(v.isNotNull()).withColumns({"_i": F.row_number().over(whole.orderBy(at, tie)) - 1, "_n": F.count("*").over(whole), "_low": F.min(v).over(whole), "_high": F.max(v).over(whole)})
    x = F.when(F.col("_n") == 1, 50.0).otherwise(F.col("_i") / (F.col("_n") - 1) * 100)
    return told.select(key, tie, x.alias("x"), (90 - (v - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1)) * 75).alias("y"))


def throttled(rows: DataFrame, *, key: str, at: str, tie: str, period: str = "hour", limit: int = 12) -> DataFrame:
    """The rows with allowed: whether a row is among the first so many of its key in its period of the calendar."""
    place = F.row_number().over(Window.partitionBy(key, F.date_trunc(period, at)).orderBy(at, tie))
    return rows.withColumn("allowed", place <= limit)


#: Attributes that a snapshot may hold.
ALLOWED = ("backup_power", "balcony", "building_number", "demo", "demo_duplicate_group", "demo_image_hashes", "demo_revision", "elevator", "furniture", "parking", "relisted_count")


def allowed(attributes: Column, names: tuple[str, ...] = ALLOWED) -> Column:
    """The entries of a map whose keys are on the list, by key; an empty map for null."""
    kept = F.map_filter(F.coalesce(attributes, F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*names))
    return F.map_from_entries(F.array_sort(F.map_entries(kept)))


def stable_json(*columns: str) -> Column:
    """The columns as JSON without spaces, names in order and nulls told."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def snapshots(listings: DataFrame, columns: list[str], *, texts: tuple[str, ...] = ("title", "description")) -> DataFrame:
    """(id, price_uah, captured_at, content_hash) of each state of a listing that differs from all its earlier ones.

    Texts enter the hash as hashes of their own, trimmed. The first of equal states is kept, by time; when a
    listing was last seen does not count, so a mere touch makes no snapshot.
    """
    named = {f"{c}_hash": F.sha2(F.trim(F.coalesce(c, F.lit(""))), 256) for c in texts}
    hashed = listings.withColumns(named).withColumn("content_hash", F.sha2(stable_json(*columns, *named), 256))
    first = F.row_number().over(Window.partitionBy("id", "content_hash").orderBy("captured_at"))
    return hashed.withColumn("place", first).where("place = 1").select("id", "price_uah", "captured_at", "content_hash")


def swept(listings: DataFrame, as_of, *, days: int) -> DataFrame:
    """The listings, those not seen for so many days no longer active; age_days tells how long ago each was seen."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("last_seen_at").cast("date"))
    return listings.withColumn("age_days", age).withColumn("is_active", F.col("is_active") & F.coalesce(F.col("age_days") <= days, F.lit(True)))


def age_days(at: Column, as_of: Column) -> Column:
    """Days, with fractions, from a time to another; 0 for what lies ahead."""
    return F.greatest((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86_400_000_000, F.lit(0.0))


def expires(at: Column, ttl_seconds: int, *, least: int = 60) -> Column:
    """When something made at a time ends: after its time to live, but no sooner than least seconds."""
    return at.cast("timestamp") + F.make_dt_interval(secs=F.lit(float(max(ttl_seconds, least))))


def iso(at: Column) -> Column:
    """A time in UTC as ISO 8601, to the second."""
    return F.date_format(F.to_utc_timestamp(at.cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def capture(listings: DataFrame, columns: list[str], *, texts: tuple[str, ...] = ("title", "description")) -> tuple[DataFrame, DataFrame]:
    """(snapshots, price events) of the states of listings: a change of price is told between a snapshot and the one before it."""
    kept = cut(snapshots(listings, columns, texts=texts))
    return kept, price_events(kept, key="id", at="captured_at", value="price_uah", tie="content_hash")
