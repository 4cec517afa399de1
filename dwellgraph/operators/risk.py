"""Risk assessment of listings: rules with weights over what other operators have found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellgraph.functions.text import clamp, folded
from dwellgraph.operators.lineage import cut

#: Phrases of texts, cities that texts name, and what a link looks like.
PREPAYMENT = ("передоплат", "завдаток до перегляду", "бронювання до перегляду", "переказати кошти", "оплата наперед")
PRESSURE = ("терміново", "без зайвих питань", "пишіть тільки в месенджер")
CITIES = ("львів", "рівне", "київ", "одеса", "дніпро", "харків")
LINK = r"(?i)https?://|www\.|t\.me/"
#: The weight of each signal, in the order in which they are told; missing fields weigh by their number.
WEIGHTS = {
    "price_far_below_market": 30, "price_below_market": 18, "duplicate_hard_conflict": 14, "images_reused_across_cities": 24, "cluster_source_conflicts": 16, "missing_basic_fields": None, "hidden_commission_hint": 12,
    "sharp_price_change": 14, "frequent_price_changes": 8, "short_description": 8, "prepayment_language": 30, "template_pressure_language": 7, "external_links_in_description": 7, "city_description_mismatch": 12,
}
PROTECTIVE = {"owner_declared": -5, "detailed_description": -4}
ELEVATED, REVIEW = 50, 25


def phrases(text: Column, known: tuple[str, ...]) -> Column:
    """The known phrases that the (case-folded) text holds."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in known]))


def image_reuse(prints: DataFrame, listings: DataFrame) -> DataFrame:
    """(id, matches, other_cities): listings of which an image's hash stands at an active listing of another city.

    By equality of a hash, the exact and the visual one alike; hashes of one city only are dropped before
    the join, so that stock photos of one agency meet nobody.
    """
    flagged = prints.join(listings.select("id", "is_active", "city"), "id")
    hashes = cut(flagged.select("id", "city_key", "is_active", "city", F.explode(F.array_distinct(F.concat("exact", "perceptual"))).alias("hash")))
    wide = hashes.groupBy("hash").agg(F.min("city_key").alias("low"), F.max("city_key").alias("high")).where("low <> high").select("hash")
    some = hashes.join(wide, "hash")
    # What a hash has in each city is brought together first: a listing meets cities, not listings.
    by_city = some.where("is_active").groupBy("hash", "city_key").agg(F.min("city").alias("other_city"), F.count("*").alias("n"))
    met = some.select("id", "hash", F.col("city_key").alias("own")).join(by_city, "hash").where("own <> city_key")
    return met.groupBy("id").agg(F.sum("n").alias("matches"), F.array_sort(F.collect_set("other_city")).alias("other_cities"))


def worst_conflict(scored: DataFrame) -> DataFrame:
    """(id, conflicts) of the pair with the greatest score among each listing's pairs with a hard conflict; ties by the other id."""
    bad = scored.where("conflict")
    ends = bad.select(F.col("left_id").alias("id"), F.col("right_id").alias("other"), "final", "conflicts").union(bad.select("right_id", "left_id", "final", "conflicts"))
    return ends.groupBy("id").agg(F.max_by("conflicts", F.struct("final", -F.col("other"))).alias("conflicts"))


def signals(listings: DataFrame) -> DataFrame:
    """The listings with points, an array of (code, weight) in the order of WEIGHTS and PROTECTIVE.

    Besides the listing's own columns it reads those of other operators, each null where nothing is known:
    deviation, confidence_label and market_status, conflicts (of the worst pair), matches (of images),
    cluster_conflicts, largest_change and change_count (of the last ten price events).
    """
    c, none = F.col, F.lit("")
    description = F.trim(F.coalesce(c("description"), none))
    text = folded(F.trim(F.concat_ws(" ", "title", "description")))
    trusted = (c("market_status") == "ready") & c("confidence_label").isin("medium", "high")
    missing = sum((F.when(F.coalesce(c(n).cast("string"), none) == "", 1).otherwise(0) for n in ("district", "street", "total_area", "floor", "commission_percent", "is_owner")), F.lit(0))
    elsewhere = F.filter(phrases(text, CITIES), lambda x: x != F.lower("city"))
    found = {
        "price_far_below_market": trusted & (c("deviation") <= -35),
        "price_below_market": trusted & (c("deviation") > -35) & (c("deviation") <= -20),
        "duplicate_hard_conflict": F.size("conflicts") > 0,
        "images_reused_across_cities": c("matches") > 0,
        "cluster_source_conflicts": c("cluster_conflicts") != "",
        "missing_basic_fields": missing >= 3,
        "hidden_commission_hint": c("hidden_commission"),
        "sharp_price_change": c("largest_change") >= 30,
        "frequent_price_changes": c("change_count") >= 3,
        "short_description": F.length(description) < 80,
        "prepayment_language": F.size(phrases(text, PREPAYMENT)) > 0,
        "template_pressure_language": F.size(phrases(text, PRESSURE)) >= 2,
        "external_links_in_description": text.rlike(LINK),
        "city_description_mismatch": F.size(elsewhere) > 0,
        "owner_declared": c("is_owner"),
        "detailed_description": F.length(description) >= 300,
    }
    weight = lambda n: F.least(4 + missing, F.lit(12)) if n == "missing_basic_fields" else F.lit((WEIGHTS | PROTECTIVE)[n])
    told = F.array(*[F.when(F.coalesce(on, F.lit(False)), F.struct(F.lit(n).alias("code"), weight(n).cast("int").alias("weight"))) for n, on in found.items()])
    return listings.withColumn("points", F.array_compact(told))


def assess(listings: DataFrame) -> DataFrame:
    """(id, score, level, codes, protective) from the columns that signals reads.

    The score is the sum of all weights, kept within 0 and 100. A listing with no description, area,
    market assessment and signal at all has insufficient_data.
    """
    told = signals(listings)
    total = clamp(F.aggregate("points", F.lit(0), lambda a, p: a + p["weight"]))
    known = (F.trim(F.coalesce("description", F.lit(""))) != "") | F.coalesce(F.col("total_area") > 0, F.lit(False)) | F.col("market_status").isNotNull() | (F.size("points") > 0)
    codes = lambda keep: F.array_join(F.transform(F.filter("points", keep), lambda p: p["code"]), "|")
    level = F.when(~known, "insufficient_data").when(total >= ELEVATED, "elevated").when(total >= REVIEW, "review").otherwise("low")
    return told.select("id", total.alias("score"), level.alias("level"), codes(lambda p: p["weight"] >= 0).alias("codes"), codes(lambda p: p["weight"] < 0).alias("protective"))


def last_changes(events: DataFrame, key: str, at: str, tie: str, last: int = 10) -> DataFrame:
    """(key, largest_change, change_count) over the last price events of each key."""
    recent = events.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie)))).where(F.col("place") <= last)
    return recent.groupBy(key).agg(F.max(F.abs("percent")).alias("largest_change"), F.count("*").alias("change_count"))


def valid_context(assessments: DataFrame, as_of, *, key: str = "id") -> DataFrame:
    """The latest assessment of each key if it is ready and still valid; an older one never takes its place.

    assessments has status, calculated_at, valid_until (null: for ever) and an id that parts ties.
    """
    order = Window.partitionBy(key).orderBy(F.desc("calculated_at"), F.desc("assessment_id"))
    latest = assessments.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
    return latest.where((F.col("status") == "ready") & (F.col("valid_until").isNull() | (F.col("valid_until") > F.lit(as_of))))
