"""The contract of listing sources, a seeded synthetic one, and ingestion from any of them."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellgraph.sources import synthetic
from dwellgraph.sources.listings import ingest_plan, land, payload_hash, quarantine


#: Fixed value: the version of the rules that make listings of raw rows.
NORMALIZATION = 4


@dataclass(frozen=True)
class Request:
    """What a source is asked for: 1 to 1000 rows of a seed in a revision from 1 to 20."""

    limit: int = 150
    seed: int = 20260716
    revision: int = 1

    def __post_init__(self):
        if not 1 <= self.limit <= 1000:
            raise ValueError("limit is from 1 to 1000")
        if not 1 <= self.revision <= 20:
            raise ValueError("revision is from 1 to 20")


class Source(Protocol):
    """A source: whether it may be read, whether it answers, its raw rows, one raw row by its id, and raw rows as listings."""

    code: str

    def approved(self) -> bool: ...

    def health(self) -> Health: ...

    def search(self, spark: SparkSession, request: Request) -> DataFrame: ...

    def details(self, spark: SparkSession, request: Request, external_id: str) -> DataFrame: ...

    def normalize(self, raw: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Health:
    """Whether a source answers, and what it says."""

    healthy: bool
    message: str


class Synthetic:
    """The data source of synthetic listings (sources.synthetic) behind the contract: all fields, of any seed and revision."""

    code = "synthetic"

    def approved(self) -> bool:
        return True

    def health(self) -> Health:
        return Health(True, "made on demand")

    def search(self, spark: SparkSession, request: Request) -> DataFrame:
        synthetic.register(spark)
        return spark.read.format(synthetic.NAME).options(limit=request.limit, seed=request.seed, revision=request.revision).load().drop("revision")

    def details(self, spark: SparkSession, request: Request, external_id: str) -> DataFrame:
        """The raw row of an id; the filter is pushed, so no other row is made."""
        return self.search(spark, request).where(F.col("external_id") == external_id)

    def normalize(self, raw: DataFrame) -> DataFrame:
        """Raw rows as listings: casts, a default for each field that a row may lack, and what all rows have in common."""
        given = lambda c, kind, default=None: (F.coalesce(F.col(c).try_cast(kind), F.lit(default)) if c in raw.columns else F.lit(default)).cast(kind).alias(c)
        fields = {c: ("string", "") for c in ("description", "district", "street", "building_type", "renovation_level", "heating_type")}
        fields |= {"latitude": ("double", None), "longitude": ("double", None), "location_accuracy": ("string", "district"), "total_area": ("double", None), "floor": ("bigint", None), "floors_total": ("bigint", None)}
        fields |= {c: ("boolean", None) for c in ("pets_allowed", "children_allowed", "is_owner")} | {"commission_percent": ("bigint", None), "published_at": ("timestamp", None), "attributes": ("string", "{}")}
        images = F.coalesce(F.col("images"), F.array().cast("array<string>")) if "images" in raw.columns else F.array().cast("array<string>")
        return raw.select(
            F.lit(self.code).alias("source_code"), F.col("external_id"), F.col("url").alias("source_url"), F.col("url").alias("canonical_url"), F.trim("title").alias("title"), F.trim("city").alias("city"),
            F.col("rooms").cast("bigint").alias("rooms"), F.col("price").cast("bigint").alias("price"), F.col("price").cast("bigint").alias("price_uah"), F.lit("UAH").alias("currency"),
            F.lit("rent").alias("deal_type"), F.lit("apartment").alias("property_type"), *[given(c, *d) for c, d in fields.items()], images.alias("images"), F.lit(True).alias("is_active"), F.lit(NORMALIZATION).alias("normalization_version"),
        )


def whole_payload(raw: DataFrame) -> Column:
    """The hash of all columns of a raw row, in the order of their names."""
    return payload_hash(*[F.col(c) for c in sorted(raw.columns)])


@dataclass(frozen=True)
class Ingested:
    """What an ingestion made: rows to land, listings after it, rows put aside, and a count of each status."""

    landed: DataFrame
    listings: DataFrame
    quarantined: DataFrame
    counts: DataFrame
    status: str


def ingest(spark: SparkSession, source: Source, request: Request, bronze: DataFrame | None, current: DataFrame | None, as_of) -> Ingested:
    """Read a source, land what is new, put bad rows aside, and bring the listings up to date.

    A source that is not approved is refused. Created and updated listings take the new row; an unchanged
    one keeps its own and is only touched: its last_seen_at is as_of. Listings are known by source and
    external id; those that the source does not name, and those of other sources, stay as they are. Where bronze and
    current are None there is nothing yet. status is what the source is to be marked: healthy, degraded if
    rows had to be put aside; one that doesn't answer is an error (its mark: unavailable).
    """
    if not source.approved():
        raise PermissionError(f"{source.code} is not approved")
    if not (health := source.health()).healthy:
        raise ConnectionError(f"{source.code} is unavailable: {health.message}")
    raw = source.search(spark, request)
    raw = raw.withColumn("payload_hash", whole_payload(raw)).withColumn("source_code", F.lit(source.code))
    keys = ["source_code", "external_id", "payload_hash"]
    landed = raw.dropDuplicates(keys) if bronze is None else land(bronze, raw, keys)
    good, bad = quarantine(raw, {"external_id": F.trim("external_id") != "", "title": F.trim("title") != "", "city": F.trim("city") != "", "price": F.col("price") > 0, "rooms": F.col("rooms") > 0})
    fresh = source.normalize(good)
    fresh = fresh.withColumns({"content_hash": whole_payload(fresh), "last_seen_at": F.lit(as_of).cast("timestamp")})
    if current is None:
        current = fresh.limit(0)
    own = current.where(F.col("source_code") == source.code).select("external_id", "content_hash")
    told = ingest_plan(own, fresh, "external_id", "content_hash")
    # Rows that are unchanged differ from the old ones in when they were seen only, so all named rows are taken anew.
    listings = current.join(told.select("source_code", "external_id"), ["source_code", "external_id"], "left_anti").unionByName(told.drop("status"))
    counts = told.groupBy("status").agg(F.count("*").alias("n")).union(bad.groupBy(F.lit("quarantined").alias("status")).agg(F.count("*").alias("n")))
    return Ingested(landed, listings, bad, counts, "healthy" if bad.isEmpty() else "degraded")
