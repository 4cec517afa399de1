"""One row a listing or cluster with its children as ordered arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def children(rows: DataFrame, key: str, name: str, fields: list[str], order: list[Column]) -> DataFrame:
    """(key, name): the rows of each key as an array of structs of fields, in an order, which must be total."""
    keys = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    item = F.struct(keys.alias("o"), F.struct(*fields).alias("row"))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["row"]).alias(name))


def falling(column: str) -> Column:
    """A key that puts the latest time first."""
    return -F.unix_micros(F.col(column).cast("timestamp"))


def listing_detail(listings: DataFrame, members: DataFrame, states: DataFrame, assessments: DataFrame, history: DataFrame) -> DataFrame:
    """The listings with cluster, role, member and source counts, price range, members, states, assessments and history.

    members has cluster, id, role, confidence and joined_by; states user_id, id and flags; assessments id, kind,
    status, calculated_at and valid_until, of which the last of each kind is taken; history id, at and price. Each
    child is brought together by its key once and joined on it; lists of listings without children are empty,
    and a listing outside clusters is the one member of its own.
    """
    facts = listings.select("id", "source_code", "price_uah", "is_active", "published_at")
    told = members.join(facts, "id")
    order = [F.col("role") != "primary", -F.col("confidence"), falling("published_at"), F.col("id")]
    price = F.when(F.col("is_active"), F.col("price_uah"))
    own = told.groupBy("cluster").agg(F.count("*").alias("member_count"), F.count_distinct("source_code").alias("source_count"), F.min(price).alias("price_min"), F.max(price).alias("price_max"))
    listed = children(told, "cluster", "members", ["id", "role", "source_code", "price_uah", "joined_by"], order)
    of_cluster = members.select("id", "cluster", "role").join(listed.join(own, "cluster"), "cluster")
    latest = assessments.groupBy("id", "kind").agg(F.max_by(F.struct("status", "valid_until"), "calculated_at").alias("last")).select("id", "kind", "last.*")
    of_state = children(states, "id", "states", ["user_id", "is_favorite", "is_hidden", "is_compared"], [F.col("user_id")])
    of_kind = children(latest, "id", "assessments", ["kind", "status"], [F.col("kind")])
    of_price = children(history, "id", "history", ["at", "price"], [F.col("at"), F.col("price")])
    out = listings.join(of_cluster, "id", "left").join(of_state, "id", "left").join(of_kind, "id", "left").join(of_price, "id", "left")
    empty = {c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("members", "states", "assessments", "history")}
    alone = {"member_count": F.lit(1), "source_count": F.lit(1), "price_min": price, "price_max": price}
    return out.withColumns(empty | {c: F.when(F.col("cluster").isNull(), v).otherwise(F.col(c)) for c, v in alone.items()} | {"is_cluster_primary": F.coalesce(F.col("role") == "primary", F.lit(True))})


def cluster_detail(nested: DataFrame, listings: DataFrame, states: DataFrame) -> DataFrame:
    """Clusters (as duplicates.nested gives them) with the primary listing, active members only, and their users' states.

    states has user_id, cluster and flags. Counts and confidences are those of all members.
    """
    fields = [c for c in listings.columns if c != "id"]
    first = listings.select(F.col("id").alias("primary_id"), F.struct("id", *fields).alias("primary"))
    of_state = children(states, "cluster", "states", ["user_id", "is_favorite", "is_hidden", "is_compared"], [F.col("user_id")])
    told = nested.withColumn("members", F.filter("members", lambda m: m["is_active"])).join(first, "primary_id", "left").join(of_state, "cluster", "left")
    return told.withColumn("states", F.coalesce("states", F.array().cast(told.schema["states"].dataType)))


def context(listings: DataFrame, market: DataFrame, risk: DataFrame) -> DataFrame:
    """(id, context): what is known of a listing as one nested value: its facts, place, conditions, and its market and risk.

    market has id, status, median, deviation and confidence_label, risk id, score and level; a listing without them
    has null there.
    """
    sides = [t.select("id", F.struct(*[c for c in t.columns if c != "id"]).alias(n)) for t, n in ((market, "market"), (risk, "risk"))]
    told = listings.join(sides[0], "id", "left").join(sides[1], "id", "left")
    place = F.struct("city", "district", "street", "lat", "lon")
    terms = F.struct("pets_allowed", "children_allowed", "commission_percent", "is_owner")
    return told.select("id", F.struct("id", "title", "price_uah", "rooms", "total_area", "floor", place.alias("location"), terms.alias("conditions"), "market", "risk").alias("context"))
