"""What a user's workspace shows of listings: map features, comparisons, cards and first payments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The newest rows that a map request inspects.
INSPECTED = 1000
#: Points by which the best of a comparison must lead.
LEAD = 5
#: Percent between the least and the greatest price of a cluster from which prices conflict.
SPREAD = 25


def map_features(scored: DataFrame, *, least: int, limit: int) -> DataFrame:
    """The first rows of a score of least or more among the newest, with place and the count inspected to find them.

    The scan ends at the last row returned, or after all rows if there are fewer than limit. Ties of time go by id.
    """
    order = [F.col("published_at").desc(), F.col("id")]
    # The request's own limit bounds the rows of this window.
    newest = scored.orderBy(*order).limit(INSPECTED).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    total = newest.agg(F.count("*").alias("total"))
    found = newest.where(F.col("score") >= least).orderBy("place").limit(limit)
    ends = found.agg(F.count("*").alias("n"), F.max("place").alias("end"))
    inspected = F.when(F.col("n") == limit, F.col("end")).otherwise(F.col("total"))
    return found.join(F.broadcast(ends.join(F.broadcast(total)).select(inspected.cast("long").alias("inspected"))))


def compare(rows: DataFrame, group: str) -> DataFrame:
    """(group, winner, gap, decisive): the best row of each group by score, known fields, price and area.

    gap is the lead over the second in points; null, and not decisive, where there is no second.
    """
    unknown = sum((F.col(c).isNull().cast("int") for c in ("total_area", "floor", "pets_allowed", "children_allowed")), F.lit(0))
    order = [F.col("score").desc(), unknown, F.col("price_uah"), F.coalesce("total_area", F.lit(0)).desc(), F.col("id")]
    w = Window.partitionBy(group).orderBy(*order)
    told = rows.withColumns({"_at": F.row_number().over(w), "gap": F.col("score") - F.lead("score").over(w)})
    return told.where("_at = 1").select(group, F.col("id").alias("winner"), "gap", F.coalesce(F.col("gap") >= LEAD, F.lit(False)).alias("decisive"))


def first_payment(price: Column, deposit_months: Column, commission_percent: Column) -> Column:
    """Rent, deposit and commission, each cut to whole units; null if the deposit is not known."""
    return (price * (1 + deposit_months)).cast("long") + (price * F.coalesce(commission_percent, F.lit(0)) / 100).cast("long")


def cluster_conflicts(members: DataFrame, cluster: str) -> DataFrame:
    """(cluster, member_count, spread, conflicts) of clusters of two at least whose sources disagree."""
    paid = F.when(F.col("price_uah") > 0, F.col("price_uah"))
    told = members.groupBy(cluster).agg(
        F.count("*").alias("member_count"),
        F.countDistinct(F.lower("city")).alias("cities"),
        F.countDistinct("rooms").alias("room_counts"),
        F.coalesce((F.max(paid) - F.min(paid)) / F.min(paid) * 100, F.lit(0.0)).alias("spread"),
    )
    conflicts = F.array_compact(F.array(F.when(F.col("cities") > 1, "city"), F.when(F.col("room_counts") > 1, "rooms"), F.when(F.col("spread") >= SPREAD, "price")))
    found = told.where("member_count > 1").withColumn("conflicts", F.array_join(conflicts, ",")).where("conflicts <> ''")
    return found.select(cluster, "member_count", F.round("spread", 2).alias("spread"), "conflicts")


def overlapping(ranges: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """The rows whose [low, high] meets the given interval, which may be open at either end."""
    return ranges.where((F.col("high") >= low if low is not None else F.lit(True)) & (F.col("low") <= high if high is not None else F.lit(True)))
