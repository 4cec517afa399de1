"""Sources of listings: the adapter over the order tables, landing, change detection and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Listing columns over orders, customer and nation, as expressions of both SQL dialects.
COLUMNS = {
    "id": "o_orderkey",
    "source_code": "c_mktsegment",
    "enabled": "c_mktsegment <> 'HOUSEHOLD'",
    "city": "n_name",
    "district": "o_orderpriority",
    "street": "c_name",
    "price_uah": "cast(round(o_totalprice) as bigint)",
    "rooms": "1 + o_custkey % 4",
    "total_area": "case when o_orderkey % 17 = 0 then null else 30 + o_custkey % 60 end",
    "floor": "nullif(o_orderkey % 15, 0)",
    "floors_total": "cast(16 as bigint)",
    "building_type": "case o_orderkey % 4 when 0 then 'brick' when 1 then 'panel' when 2 then 'new_building' else '' end",
    "renovation_level": "case o_orderkey % 3 when 0 then 'modern' when 1 then 'basic' else '' end",
    "heating_type": "case o_orderkey % 5 when 0 then '' else 'individual' end",
    "pets_allowed": "case o_orderkey % 3 when 0 then true when 1 then false end",
    "children_allowed": "case o_orderkey % 3 when 1 then true when 2 then false end",
    "is_owner": "case o_orderkey % 3 when 2 then true when 0 then false end",
    "commission_percent": "case o_orderkey % 4 when 0 then 0 when 1 then 50 when 2 then 100 end",
    "lat": "48.0e0 + n_nationkey * 1.0e-1 + (o_custkey % 50) * 1.0e-3",
    "lon": "24.0e0 + (n_nationkey % 5) * 1.0e-1 + (o_orderkey % 50) * 1.0e-3",
    "published_at": "o_orderdate",
    "is_active": "o_orderstatus <> 'P'",
    "external_id": "'x' || cast(o_orderkey % 7000 as string)",
    "legal_status": "case c_mktsegment when 'MACHINERY' then 'approved_demo' when 'FURNITURE' then 'under_review' else 'approved' end",
    "health_status": "case c_mktsegment when 'BUILDING' then 'degraded' else 'healthy' end",
    "deal_type": "'rent'",
    "property_type": "case o_orderkey % 11 when 0 then 'house' else 'apartment' end",
    "location_accuracy": "case o_orderkey % 4 when 0 then 'building' when 1 then 'street' when 2 then 'district' else '' end",
    "title": "cast(1 + o_custkey % 4 as string) || '-кімнатна квартира, ' || c_name",
    "description": """case o_orderkey % 6 when 0 then 'Терміново! Без зайвих питань, передоплата. Дзвоніть 0671234567' when 1 then 'Деталі на https://example.org/a, поруч Київ'
      when 2 then '' when 3 then repeat('Світла простора квартира з ремонтом. ', 10) when 4 then 'Пошта Owner' || cast(o_custkey % 50 as string) || '@example.org або @owner_' || cast(o_custkey % 9 as string) else 'Квартира з меблями, телефонуйте' end""",
    "image_one": "case when o_orderkey % 3 > 0 then 'https://img.example.org/' || cast(o_custkey % 97 as string) || '.jpg' end",
    "image_two": "case when o_orderkey % 3 = 2 then 'https://img.example.org/b' || cast(o_custkey % 89 as string) || '.jpg' end",
    "perceptual": "case when o_orderkey % 3 > 0 then substr(md5(cast(o_custkey % 61 as string)), 1, 16) end",
    "attributes": """case o_orderkey % 9 when 0 then '{"contacts":{"agent":[{"Phone":"067' || lpad(cast(o_custkey % 300 as string), 7, '1') || '"},["x",{"deep":{"e":"Shared' || cast(o_custkey % 70 as string) || '@example.org"}}]],"age":5},"note":"0671112233"}'
      when 1 then '{"demo_duplicate_group":"g' || cast(o_custkey % 40 as string) || '"}' when 2 then '{"trusted_image_hashes":[{"sha256":" ' || upper(md5(cast(o_custkey % 30 as string))) || md5('x') || '","dhash":"' || substr(md5(cast(o_custkey % 30 as string)), 1, 16) || '"},{"sha256":"short"},{"dhash":7}]}'
      when 3 then '{"house_number":null,"building_number":"' || cast(o_custkey % 90 as string) || '-A"}' when 4 then 'no json' when 5 then '{"Viber":"0501234567 or @some_handle"}' else '{}' end""",
    "backup_power": "case o_orderkey % 4 when 0 then true when 1 then false end",
    "hidden_commission": "o_orderkey % 13 = 0",
    "deposit_months": "case when o_orderkey % 4 > 0 then (o_orderkey % 4) * 5.0e-1 end",
}
#: Which listings users see and duplicates are looked for among.
APPROVED = "is_active and enabled and legal_status in ('approved', 'approved_demo')"
LISTINGS_SQL = "select " + ", ".join(f"{e} as {n}" for n, e in COLUMNS.items()) + " from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"


def fixture_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings from the order tables; the planner broadcasts the small nation table by its size."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    joined = read("orders").join(read("customer"), F.expr("o_custkey = c_custkey")).join(read("nation"), F.expr("c_nationkey = n_nationkey"))
    return joined.select(*[F.expr(e).alias(n) for n, e in COLUMNS.items()])


def payload_hash(*columns: Column) -> Column:
    """SHA-256 of the columns' texts joined by a separator that texts do not hold; null counts as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def land(bronze: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The incoming rows whose keys (source, external id, payload hash) have not landed before, once each."""
    return incoming.dropDuplicates(keys).join(bronze.select(*keys), keys, "left_anti")


def ingest_plan(current: DataFrame, incoming: DataFrame, key: str, hash_column: str) -> DataFrame:
    """Each incoming row with its status: created, updated (other hash) or unchanged."""
    old = current.select(F.col(key), F.col(hash_column).alias("old_hash"), F.lit(True).alias("known"))
    status = F.when(F.col("known").isNull(), "created").when(F.col(hash_column).eqNullSafe(F.col("old_hash")), "unchanged").otherwise("updated")
    return incoming.join(old, key, "left").withColumn("status", status).drop("old_hash", "known")


def upsert(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The current rows with those of incoming put in their place or added."""
    return current.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def quarantine(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with the names of the checks that they fail); a null check fails."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    told = rows.withColumn("failed", failed)
    return told.where(F.size("failed") == 0).drop("failed"), told.where(F.size("failed") > 0)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by the order, which must be total."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_at", at).where("_at = 1").drop("_at")
