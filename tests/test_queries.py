"""Registered queries against their SQL, and golden facts."""

import datetime
import os
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

SF = Path("/root/testdata/sf0.001")


def values(rows):
    return sorted((tuple(round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v) for v in r) for r in rows), key=str)


def catalogue():
    from dwellgraph.plans import catalogue, more  # noqa: F401

    return catalogue


@pytest.mark.skipif(not SF.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalogue().ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    df = catalogue().QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    theirs = con.execute(f"select {', '.join(f'\"{c}\"' for c in columns)} from ({catalogue().ORACLE_SQL[name]})").fetchall()
    ours = [[x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x for x in r] for r in df.select(*columns).collect()]
    assert values(ours) == values(theirs)


def market_rows(spark, prices, **more):
    rows = [(0, "A", "d", 1, 16000, 40), *[(i + 1, "a", "d", 1, p, 40) for i, p in enumerate(prices)]]
    t = spark.createDataFrame(rows, "id bigint, city string, district string, rooms bigint, price_uah bigint, total_area bigint")
    return t.withColumns({"building_type": F.lit(""), "renovation_level": F.lit(""), "published_at": F.lit("2024-01-10").cast("timestamp"), "lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double"), "cluster": F.lit(None).cast("bigint"), "role": F.lit(None).cast("string")} | more)


NOW = datetime.datetime(2024, 1, 11)


def test_market_golden(spark):
    from dwellgraph.operators import market

    t = market_rows(spark, [14000, 15000, 16000, 17000, 18000, 60000])
    target = t.where("id = 0")
    got = market.assess(target, market.comparables(target, t, NOW, least=4), NOW, least=4).first()
    assert (got.status, got.n, got.median, got.q1, got.q3, got.outliers, float(got.deviation)) == ("ready", 6, 16500, 15250, 17750, 1, -3.03)
    assert (got.stage, got.candidates, got.own_per_area, got.median_per_area) == ("district_rooms_area", 6, 400.0, 412.5)
    few = market.assess(target, market.comparables(target, t, NOW, least=8), NOW, least=8).first()
    assert (few.status, few.n, few.median, few.confidence_label, few.stage) == ("insufficient", 6, None, "low", "city_rooms")


def test_market_leaves_out_the_stale_the_inactive_and_the_own_cluster(spark):
    from dwellgraph.operators import market

    t = market_rows(spark, [15000 + 500 * i for i in range(8)], published_at=F.when(F.col("id") == 8, F.lit("2023-01-10")).otherwise("2024-01-10").cast("timestamp"), cluster=F.when(F.col("id").isin(0, 1, 2), 7).when(F.col("id") == 3, 8).cast("bigint"), role=F.when(F.col("id").isin(1, 3), "primary").when(F.col("id") < 3, "duplicate"))
    target = t.where("id = 0")
    got = market.comparables(target, t, NOW, least=2).collect()
    assert sorted(r.id for r in got) == [3, 4, 5, 6, 7] and {r.candidates for r in got} == {5}
    few = sorted(r.id for r in market.comparables(target, t, NOW, least=2, most=3).collect())
    assert few == [3, 4, 5] and market.comparables(target.limit(0), t, NOW).count() == 0


def test_price_change_golden(spark):
    from dwellgraph.operators import history

    rows = spark.createDataFrame([("x", 1, 1, 15000), ("x", 2, 2, 13500), ("x", 3, 3, 13500), ("y", 1, 4, None)], "k string, ts int, event_id int, v int")
    got = history.price_events(rows, key="k", at="ts", value="v", tie="event_id").collect()
    assert [(r.old, r.new, r.change, float(r.percent), r.kind) for r in got] == [(15000, 13500, -1500, -10.0, "decrease")]


def test_text_golden(spark):
    from dwellgraph.functions import text

    assert spark.range(1).select(text.norm_text(F.lit("  ВУЛ. Наукова, 10! "))).first()[0] == "вулиця наукова 10"
    assert spark.range(1).select(text.phone(F.lit("067 123 45 67"))).first()[0] == "380671234567"


def listings_of(spark, ids):
    """Listings with the columns of a quality, the higher the id the better."""
    rows = [(i, i) for i in ids]
    t = spark.createDataFrame(rows, "id bigint, floor bigint")
    text = {c: F.lit("") for c in ("district", "street", "building_type", "renovation_level", "heating_type", "location_accuracy", "source_code", "image_one", "image_two")}
    none = {"total_area": F.lit(None).cast("double"), "floors_total": F.lit(None).cast("bigint"), "pets_allowed": F.lit(None).cast("boolean"), "children_allowed": F.lit(None).cast("boolean"), "is_owner": F.lit(None).cast("boolean"), "commission_percent": F.lit(None).cast("bigint")}
    rest = {"is_active": F.lit(True), "enabled": F.lit(True), "legal_status": F.lit("approved"), "health_status": F.lit("healthy"), "price_uah": F.lit(1), "published_at": F.lit("2024-01-01").cast("timestamp")}
    return t.withColumns(text | none | rest)


@pytest.mark.parametrize("one_task", [200_000, 12])
def test_guarded_clusters_equal_brute_force(spark, one_task):
    """Random graphs, decisions and conflicts, against a plain reading of the rule; settled by tasks and by rounds."""
    import random

    from dwellgraph.operators import guarded

    rng = random.Random(3)
    edges = {}
    for group in range(6):
        ids = range(100 * group, 100 * group + (3, 4, 6, 8, 9, 12)[group])
        for a in ids:
            for b in ids:
                if a < b and rng.random() < (0.95 if group % 2 else 0.8):
                    score = rng.choice([70.0, 80.0, 93.0, 95.0, 96.0, 99.0])
                    edges[a, b] = (score, "split" if rng.random() < 0.01 else "auto_merge" if score >= 92 else "needs_review" if score >= 78 else "rejected", ["rooms"] if rng.random() < 0.02 else [])

    def fits(a, b):
        e = edges.get((min(a, b), max(a, b)))
        return e is not None and e[1] != "split" and not e[2] and (e[1] == "auto_merge" or e[0] >= 78)

    def allowed(m):
        pairs = [(a, b) for a in m for b in m if a < b]
        if any(edges.get(p, (0, ""))[1] == "split" for p in pairs):
            return False
        good = sum(fits(*p) for p in pairs)
        return good == len(pairs) if len(m) <= 5 else good >= 0.7 * len(pairs) and all(fits(max(m), x) for x in m if x != max(m))

    cluster = {i: {i} for e in edges for i in e}
    for a, b in sorted((e for e in edges if edges[e][1] == "auto_merge"), key=lambda e: (edges[e][0], max(e), min(e)), reverse=True):
        if cluster[a] is not cluster[b] and allowed(cluster[a] | cluster[b]):
            both = cluster[a] | cluster[b]
            for i in both:
                cluster[i] = both
    want = {i: min(c) for i, c in cluster.items() if len(c) > 1}
    scored = spark.createDataFrame([(a, b, s, d, c) for (a, b), (s, d, c) in edges.items()], "left_id bigint, right_id bigint, final double, decision string, conflicts array<string>")
    got = {r.id: r.cluster for r in guarded.guarded_clusters(scored, listings_of(spark, cluster), one_task=one_task).collect()}
    assert got == want and len(set(want.values())) > 5


def test_stream_first_seen(spark):
    from dwellgraph.streaming import streams

    top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame([(1, datetime.datetime(2024, 1, 1)), (1, datetime.datetime(2024, 1, 1, 0, 5)), (2, datetime.datetime(2024, 1, 1))], "k int, ts timestamp").write.parquet(f"{top}/in")
    stream = spark.readStream.schema("k int, ts timestamp").parquet(f"{top}/in")
    streams.run_once(streams.first_seen(stream, ["k"]), f"{top}/out", f"{top}/state")
    assert os.path.isdir(f"{top}/out") and sorted(r.k for r in spark.read.parquet(f"{top}/out").collect()) == [1, 2]


def test_profile_bounds():
    from dwellgraph.operators.matching import Profile

    with pytest.raises(ValueError):
        Profile("x", 2, 1)
