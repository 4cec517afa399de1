"""Duplicates kept up to date: only what changed listings can touch is made again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgraph.operators import duplicates
from dwellgraph.operators.fingerprints import fingerprints
from dwellgraph.operators.graph import components
from dwellgraph.operators.guarded import guarded_clusters
from dwellgraph.operators.lineage import cut


@dataclass(frozen=True)
class Detection:
    """What a detection leaves: fingerprints, scored pairs, components of accepted pairs, and clusters."""

    prints: DataFrame
    scored: DataFrame
    components: DataFrame
    clusters: DataFrame


def _decided(scored: DataFrame, log: DataFrame | None) -> DataFrame:
    return scored if log is None else duplicates.with_manual(scored, log)


def _accepted(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("decision").isin(*duplicates.ACCEPTED)).select("left_id", "right_id")


def detect(listings: DataFrame, *, log: DataFrame | None = None, cap: int | None = duplicates.BLOCK_CAP, text: bool | str = "needed", **keys) -> Detection:
    """The duplicates among listings, which are the ones to compare (active, of approved sources).

    log has the manual decisions; text goes to score(), keys to fingerprints().
    """
    prints = cut(fingerprints(listings, keep=duplicates.COMPARED, **keys))
    scored = cut(duplicates.score_blocks(prints, cap=cap, text=text))
    decided = _decided(scored, log)
    labels = cut(components(_accepted(decided)))
    return Detection(prints, scored, labels, cut(guarded_clusters(decided, listings, labels=labels)))


def redetect(before: Detection, listings: DataFrame, changed: DataFrame, *, log: DataFrame | None = None, reviewed: DataFrame | None = None, cap: int | None = duplicates.BLOCK_CAP, text: bool | str = "needed", **keys) -> Detection:
    """The detection over listings as they are now, from one over listings that differ by the ids of changed only.

    changed has the ids (id) that are new, altered or gone; reviewed those of pairs whose manual decision is another
    than it was. Equal to detect() over all listings: pairs are made again for changed listings, and for
    those that come to be or cease to be among the first of their city, which the cap goes by; clusters
    for every component, old or new, that holds one of these or meets one by an accepted pair. All
    else is taken over, so the work goes with the changes, apart from passes over the kept tables.
    """
    changed = cut(changed.select("id").distinct())
    prints = cut(before.prints.join(changed, "id", "left_anti").unionByName(fingerprints(listings.join(changed, "id", "left_semi"), keep=duplicates.COMPARED, **keys)))
    touched = changed
    if cap is not None:
        was, now = (duplicates.block_leaders(p.select("id", "city_key"), cap).select("id") for p in (before.prints, prints))
        touched = cut(changed.union(was.exceptAll(now)).union(now.exceptAll(was)).distinct())
    ends = lambda s: touched.withColumnRenamed("id", f"{s}_id")
    kept = before.scored.join(ends("left"), "left_id", "left_anti").join(ends("right"), "right_id", "left_anti")
    made = duplicates.score(duplicates.block_pairs(prints, cap=cap, text=bool(text), only=touched), listings, prints, text=text)
    scored = cut(kept.unionByName(made))
    decided = _decided(scored, log)
    # Whose component may be another: the touched, and whom they meet now.
    seeds = touched if reviewed is None else touched.union(reviewed.select("id")).distinct()
    accepted = cut(_accepted(decided))
    both = accepted.union(accepted.select("right_id", "left_id")).toDF("id", "other")
    met = cut(seeds.union(both.join(seeds, "id", "left_semi").select("other")).distinct())
    names = before.components.join(met, "id", "left_semi").select("component").distinct()
    affected = cut(met.union(before.components.join(names, "component", "left_semi").select("id")).distinct())
    inside = lambda rows: rows.join(affected.withColumnRenamed("id", "left_id"), "left_id", "left_semi").join(affected.withColumnRenamed("id", "right_id"), "right_id", "left_semi")
    labels = cut(components(inside(accepted)))
    clusters = guarded_clusters(inside(decided), listings.join(affected, "id", "left_semi"), labels=labels)
    over = lambda rows: rows.join(affected, "id", "left_anti")
    return Detection(prints, scored, cut(over(before.components).unionByName(labels)), cut(over(before.clusters).unionByName(clusters)))


def rebuild_city(before: Detection, listings: DataFrame, city: str, **options) -> Detection:
    """redetect() with every listing of a city, by its normalised name, taken as changed."""
    from dwellgraph.functions.text import norm_text

    named = norm_text(F.lit(city))
    ids = before.prints.where(F.col("city_key") == named).select("id").union(listings.where(norm_text(F.col("city")) == named).select("id"))
    return redetect(before, listings, ids, **options)
