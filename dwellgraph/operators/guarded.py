"""Guarded clusters of accepted pairs: a sequential rule, decided in parallel rounds wherever its order leaves no choice."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgraph.operators.duplicates import ACCEPTED, SHARE, SMALL_CLUSTER, compatible, with_quality
from dwellgraph.operators.graph import components
from dwellgraph.operators.lineage import cut, forget, importable

#: A component of so many pairs at most is settled by one task; larger ones go through rounds until so few pairs are open.
ONE_TASK = 200_000

_SETTLED = "id bigint, cluster bigint"
_LINK = ["c", "d", "size_c", "inner_c", "place_c", "size_d", "inner_d", "place_d", "good", "split", "fit_c", "fit_d", "ranks"]


def may_merge(size_c: Column, size_d: Column, inner: Column, first: Column, fit_c: Column, fit_d: Column, split: Column) -> Column:
    """Whether two clusters may become one, by their sizes and counts of compatible pairs.

    inner counts the pairs within the union, first tells that the first cluster has the better primary; fit_c counts the
    second's members that are compatible with the first's primary, fit_d the other way round. Members of a
    cluster are all compatible with its primary, so these counts tell whether the union's are.
    """
    members = size_c + size_d
    pairs = members * (members - 1) / 2
    fits = F.when(first, fit_c == size_d).otherwise(fit_d == size_c)
    return ~split & F.when(members <= SMALL_CLUSTER, inner == pairs).otherwise(fits & (inner >= F.ceil(pairs * SHARE)))


def settle(rows) -> dict[int, int]:
    """Cluster -> the smallest name of those it ends up with, of one component's links (a pandas table, columns _LINK).

    Links are pairs of clusters, with the counts that may_merge needs and the ranks of their accepted pairs. All
    counts are sums over members, so a merge adds the links of the one to those of the other.
    """
    size, inner, place, near, edges = {}, {}, {}, {}, []
    for r in rows.itertuples():
        for x, s, n, p in ((r.c, r.size_c, r.inner_c, r.place_c), (r.d, r.size_d, r.inner_d, r.place_d)):
            size[x], inner[x], place[x] = s, n, p
        near.setdefault(r.c, {})[r.d] = [r.good, r.split, r.fit_c]
        near.setdefault(r.d, {})[r.c] = [r.good, r.split, r.fit_d]
        edges += [(k, r.c, r.d) for k in r.ranks]
    into = {x: x for x in size}
    name = dict(into)

    def top(x):
        while into[x] != x:
            into[x] = x = into[into[x]]
        return x

    for _, a, b in sorted(edges):
        x, y = top(a), top(b)
        if x == y:
            continue
        (good, split, of_y), of_x = near[x][y], near[y][x][2]
        members, within, first = size[x] + size[y], inner[x] + inner[y] + good, place[x] < place[y]
        pairs = members * (members - 1) // 2
        if split or not (within == pairs if members <= SMALL_CLUSTER else (of_y == size[y] if first else of_x == size[x]) and within >= math.ceil(pairs * SHARE)):
            continue
        if len(near[x]) < len(near[y]):
            x, y, first = y, x, not first
        del near[x][y], near[y][x]
        if not first:  # the other's primary goes on, so what fits with this one's counts no more
            for link in near[x].values():
                link[2] = 0
        for z, (good, split, fit) in near.pop(y).items():
            for link, more in ((near[x].setdefault(z, [0, False, 0]), 0 if first else fit), (near[z].setdefault(x, [0, False, 0]), near[z].pop(y)[2])):
                link[0], link[1], link[2] = link[0] + good, link[1] or split, link[2] + more
        size[x], inner[x], place[x], name[x] = members, within, min(place[x], place[y]), min(name[x], name[y])
        into[y] = x
    return {x: name[top(x)] for x in into}


def _settled(group):
    import pandas as pd

    of = settle(group)
    return pd.DataFrame({"id": list(of), "cluster": list(of.values())}, dtype="int64")


def ordered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """The rows with a number that rises with the order, which must be total: by ranges, in no single task."""
    return cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))


def _prepared(scored: DataFrame, listings: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Links of single listings, with the component of each: pairs within a component that can have a say."""
    accepted = F.col("decision").isin(*ACCEPTED)
    told = cut(scored.select("left_id", "right_id", "final", accepted.alias("accepted"), compatible(scored).alias("fits"), (F.col("decision") == "split").alias("split")).where("accepted or fits or split"))
    labels = cut(components(told.where("accepted").select("left_id", "right_id"))) if labels is None else labels
    places = ordered(with_quality(listings.join(labels.select("id"), "id", "left_semi")).select("id", "quality"), "place", F.desc("quality")).select("id", "place").join(labels, "id")
    of = lambda s: places.select(F.col("id").alias(f"{s}_id"), F.col("place").alias(f"place_{s}"), F.col("component").alias(f"{s}_component"))
    inside = told.join(of("left"), "left_id").join(of("right"), "right_id").where("left_component = right_component")
    order = [F.desc("final"), F.least("place_left", "place_right"), F.greatest("place_left", "place_right"), F.desc("left_id"), F.desc("right_id")]
    inside = cut(inside)
    ranked = ordered(inside.where("accepted"), "rank", *order).select("left_id", "right_id", "rank")
    one, fit = F.lit(1).cast("bigint"), F.col("fits").cast("bigint")
    none = F.lit(0).cast("bigint")
    links = inside.join(ranked, ["left_id", "right_id"], "left").select(
        F.col("left_component").alias("component"), F.col("left_id").alias("c"), F.col("right_id").alias("d"), one.alias("size_c"), none.alias("inner_c"), F.col("place_left").alias("place_c"),
        one.alias("size_d"), none.alias("inner_d"), F.col("place_right").alias("place_d"), fit.alias("good"), "split", fit.alias("fit_c"), fit.alias("fit_d"), F.array_compact(F.array("rank")).alias("ranks"),
    )
    return cut(links)


def guarded_clusters(scored: DataFrame, listings: DataFrame, *, one_task: int = ONE_TASK, labels: DataFrame | None = None) -> DataFrame:
    """(id, cluster) of listings in clusters of two or more, named by their smallest id.

    Accepted pairs are taken by falling score, then by the qualities of their ends and their ids, and merge
    two clusters if may_merge allows it: no pair of the union is split and, of SMALL_CLUSTER members or
    fewer, all pairs are compatible; of more, SHARE of the pairs and all with the member of the best quality. The
    rule is sequential, but components of accepted pairs have no effect on each other: those of at most
    one_task pairs are settled by a task each, larger ones by rounds, which no task sees in whole. Ids are
    whole numbers; pairs of listings that the table lacks have no effect. labels are the components of the
    accepted pairs (id, component), if they are known.
    """
    importable(scored.sparkSession)
    links = _prepared(scored, listings, labels)
    wide = links.groupBy("component").count().where(F.col("count") > one_task).select("component")
    wide = cut(wide)
    found = links
    settled = None
    if n := wide.count():
        wide = F.broadcast(wide) if n <= 100_000 else wide
        settled = _by_rounds(links.join(wide, "component", "left_semi"), one_task)
        found = links.join(wide, "component", "left_anti")
    told = found.groupBy("component").applyInPandas(_settled, _SETTLED)
    told = cut(told if settled is None else told.union(settled))
    many = told.groupBy("cluster").count().where("count > 1").select("cluster")
    return told.join(many, "cluster", "left_semi").select("id", "cluster")


def _by_rounds(links: DataFrame, one_task: int) -> DataFrame:
    """(id, cluster) of the listings of links, whose clusters are single listings.

    In a round, the clusters being as they are, each open edge (accepted pair of two clusters) is a yes or a no.
    A yes changes its clusters, and so puts later edges of theirs in doubt, which in turn may come to be a yes: the
    first edge in doubt is found for each cluster, by grouped minima. What comes before it is decided: a no is rejected,
    and a yes that is the first of both its clusters is merged. The first of all open edges always is. Splits
    last, and clusters without an open edge stay as they are. Counts of links are sums, so clusters are
    relabelled and links summed again; the last one_task links are settled by one task.
    """
    ends = [links.select(F.col(x).alias("c"), F.col(f"size_{x}").alias("size"), F.col(f"inner_{x}").alias("inner"), F.col(f"place_{x}").alias("place")) for x in "cd"]
    nodes = cut(ends[0].union(ends[1]).distinct())
    members = nodes.select(F.col("c").alias("id"), F.col("c").alias("cluster"))
    pairs = cut(links.select("c", "d", "good", "split", "fit_c", "fit_d"))
    edges = cut(links.select("c", "d", F.explode("ranks").alias("rank")))
    while True:
        edges = edges.join(pairs.where("split").select("c", "d"), ["c", "d"], "left_anti")
        live = cut(edges.select(F.col("c").alias("x")).union(edges.select(F.col("d").alias("x"))).distinct())
        pairs = pairs.join(live.select(F.col("x").alias("c")), "c", "left_semi").join(live.select(F.col("x").alias("d")), "d", "left_semi")
        side = lambda x: nodes.select(F.col("c").alias(x), F.col("size").alias(f"size_{x}"), F.col("inner").alias(f"inner_{x}"), F.col("place").alias(f"place_{x}"))  # noqa: E731, B023
        whole = cut(pairs.join(side("c"), "c").join(side("d"), "d"))
        if (left := whole.count()) <= one_task:
            if left:
                ranks = edges.groupBy("c", "d").agg(F.collect_list("rank").alias("ranks"))
                last = whole.join(ranks, ["c", "d"], "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<bigint>"))).select(*_LINK)
                of = last.groupBy(F.lit(0).alias("all")).applyInPandas(lambda g: _settled(g[_LINK]), _SETTLED).select(F.col("id").alias("cluster"), F.col("cluster").alias("to"))
                members = members.join(cut(of), "cluster", "left").select("id", F.coalesce("to", "cluster").alias("cluster"))
            return members
        yes = may_merge(F.col("size_c"), F.col("size_d"), F.col("inner_c") + F.col("inner_d") + F.col("good"), F.col("place_c") < F.col("place_d"), F.col("fit_c"), F.col("fit_d"), F.col("split"))
        asked = cut(edges.join(whole.select("c", "d", yes.alias("yes")), ["c", "d"]))
        doubt = _first_in_doubt(asked)
        near = lambda x: doubt.select(F.col("x").alias(x), F.col("rank").alias(f"doubt_{x}"))  # noqa: E731, B023
        told = cut(asked.join(near("c"), "c", "left").join(near("d"), "d", "left"))
        merged = told.where("yes and rank = doubt_c and rank = doubt_d").select("c", "d")
        merged = merged.join(whole, ["c", "d"]).select("c", "d", "good", F.least("c", "d").alias("to"), (F.col("place_c") < F.col("place_d")).alias("first"))
        moved = cut(merged.select(F.col("c").alias("x"), "to", F.col("first").alias("leads"), "good").union(merged.select("d", "to", ~F.col("first"), F.lit(0).cast("bigint"))))
        # Relabel: clusters, their links (what fits with a primary that leads no more counts nothing), open edges, members.
        named = lambda rows, x: rows.join(moved.select(F.col("x").alias(x), F.col("to").alias(f"to_{x}"), F.col("leads").alias(f"leads_{x}")), x, "left")  # noqa: E731, B023
        at = lambda x: F.coalesce(f"to_{x}", x)
        gone = nodes.join(moved.withColumnRenamed("x", "c"), "c", "left").select(F.coalesce("to", "c").alias("c"), "size", (F.col("inner") + F.coalesce("good", F.lit(0))).alias("inner"), "place")
        nodes = cut(gone.groupBy("c").agg(F.sum("size").alias("size"), F.sum("inner").alias("inner"), F.min("place").alias("place")))
        fit = lambda x: F.when(F.coalesce(f"leads_{x}", F.lit(True)), F.col(f"fit_{x}")).otherwise(0)
        both = named(named(whole.select("c", "d", "good", "split", "fit_c", "fit_d"), "c"), "d").select(at("c").alias("a"), at("d").alias("b"), "good", "split", fit("c").alias("fit_a"), fit("d").alias("fit_b")).where("a <> b")
        turned = both.select(F.least("a", "b").alias("c"), F.greatest("a", "b").alias("d"), "good", "split", F.when(F.col("a") < F.col("b"), F.col("fit_a")).otherwise(F.col("fit_b")).alias("fit_c"), F.when(F.col("a") < F.col("b"), F.col("fit_b")).otherwise(F.col("fit_a")).alias("fit_d"))
        pairs = cut(turned.groupBy("c", "d").agg(F.sum("good").alias("good"), F.max("split").alias("split"), F.sum("fit_c").alias("fit_c"), F.sum("fit_d").alias("fit_d")))
        decided = ~F.col("yes") & F.coalesce(F.col("rank") < F.col("doubt_c"), F.lit(True)) & F.coalesce(F.col("rank") < F.col("doubt_d"), F.lit(True))
        still = named(named(told.where(~decided).select("c", "d", "rank"), "c"), "d").select(F.least(at("c"), at("d")).alias("c"), F.greatest(at("c"), at("d")).alias("d"), "rank")
        edges = cut(still.where("c <> d"))
        members = cut(members.join(moved.select(F.col("x").alias("cluster"), "to"), "cluster", "left").select("id", F.coalesce("to", "cluster").alias("cluster")))
        forget(live, whole, asked, doubt, told, moved)


def _first_in_doubt(asked: DataFrame) -> DataFrame:
    """(x, rank): each cluster's first edge that is a yes, or that comes after the first in doubt of its other cluster."""
    both = cut(asked.select(F.col("c").alias("x"), F.col("d").alias("y"), "rank", "yes").union(asked.select("d", "c", "rank", "yes")))
    doubt = cut(both.where("yes").groupBy("x").agg(F.min("rank").alias("rank")))
    noes = both.where("not yes")
    fresh = cut(doubt)
    while True:
        late = noes.join(fresh.select("x", F.col("rank").alias("since")), "x").where("rank > since").groupBy(F.col("y").alias("x")).agg(F.min("rank").alias("late"))
        before, fresh = fresh, cut(late.join(doubt, "x", "left").where("rank is null or late < rank").select("x", F.col("late").alias("rank")))
        forget(before)
        if fresh.isEmpty():
            forget(both, fresh)
            return doubt
        old, doubt = doubt, cut(doubt.union(fresh).groupBy("x").agg(F.min("rank").alias("rank")))
        forget(old)
