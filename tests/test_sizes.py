"""Queries and operators on inputs larger than the tables of the other tests, against their SQL or a plain reading."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

import pytest

SF = Path("/root/testdata/sf0.001")


def queries():
    import __spark_entry__

    return __spark_entry__.queries(), __spark_entry__.oracle_sql()


def equal_to_sql(spark, name, folder):
    """Whether the query and its SQL give the same rows over a folder, and how many."""
    import duckdb

    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    ours, sql = queries()
    got = ours[name](spark, str(folder))
    columns = sorted(got.columns)
    rows = lambda found: sorted((tuple(round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v) for v in r) for r in found), key=str)
    told = rows(got.select(*columns).collect())
    return told == rows(con.execute(f"select {', '.join(columns)} from ({sql[name]})").fetchall()), len(told)


def repeated(table, keys, times):
    """A folder of the small tables, of which one stands there so many times, with its keys shifted."""
    import duckdb

    folder = Path(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    for f in SF.glob("*.parquet"):
        shutil.copy(f, folder) if f.stem != table else None
    shifted = ", ".join(f"({k} + i * {step})::bigint as {k}" for k, step in keys.items())
    duckdb.connect().execute(f"copy (select * replace ({shifted}) from '{SF}/{table}.parquet', range({times}) r(i)) to '{folder}/{table}.parquet' (format parquet)")
    return folder


@pytest.mark.skipif(not SF.exists(), reason="no tables here")
def test_all_that_are_due_are_told(spark):
    """More users are due by one kind than a batch holds."""
    same, n = equal_to_sql(spark, "due_for_any", repeated("events", {"user_id": 100_000}, 80))
    assert same and n > 1000


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.skipif(not SF.exists(), reason="no tables here")
@pytest.mark.parametrize("text", [False, True])
def test_few_leaders_make_the_pairs_of_many(spark, text):
    """Leaders that go to all tasks, and a pair at its first block, against joins and distinct pairs."""
    from dwellgraph.operators import duplicates, fingerprints
    from dwellgraph.operators.lineage import cut
    from dwellgraph.plans import catalogue

    prints = cut(fingerprints.fingerprints(catalogue.approved(spark, str(SF)), keep=duplicates.COMPARED))
    few, many = (duplicates.block_pairs(prints, text=text, cap=9, few=n) for n in (10**6, 0))
    assert rows_of(few) == rows_of(many) and 100 < few.count() < duplicates.block_pairs(prints, text=text).count()
    whole, parted = (duplicates.score_blocks(prints, text=False, cap=9, few=n) for n in (10**6, 0))
    assert rows_of(whole) == rows_of(parted)


@pytest.mark.skipif(not SF.exists(), reason="no tables here")
@pytest.mark.parametrize("name", ["block_pairs", "block_pairs_by_text", "pair_final", "pair_decision_counts", "edges_of_listing", "worst_conflicts", "pair_scores_with_text", "pair_decisions_with_text"])
def test_pairs_read_fingerprints_and_do_not_make_them_again(spark, name):
    """The plan has one join with the leaders: no fingerprint is made in it, and no pair is sorted to meet its listings."""
    plan = queries()[0][name](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 6 and plan.count("regexp_replace") == 0 and len(plan) < 200_000
    assert plan.count("SortMergeJoin") == 0


@pytest.mark.skipif(not SF.exists(), reason="no tables here")
@pytest.mark.parametrize("name", ["market_assessment", "market_confidence", "listing_context", "comparables_stage_choice", "comparables_topn"])
def test_comparables_are_not_dealt_out(spark, name):
    """A target is a row that meets the list of its like; comparables are neither ranked nor summed up by target."""
    plan = queries()[0][name](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "percentile" not in plan and "hashpartitioning(target" not in plan


def test_assessments_of_rows_are_those_of_arrays(spark):
    """Samples of one, of an even and of an odd number, without areas, and a target without any."""
    import datetime

    from pyspark.sql import functions as F

    from dwellgraph.operators import market

    now = datetime.datetime(2024, 1, 31)
    rows = [(i, "A", "d" if i % 3 else "", i % 4, 9000 + 37 * (i * i % 50), None if i % 7 == 0 else 20.0 + i % 31, "x" if i % 2 else "", "", now - datetime.timedelta(days=i % 40), None, None, None, None) for i in range(60)] + [(99, "B", "d", 1, 5000, 40.0, "", "", now, None, None, None, None)]
    t = spark.createDataFrame(rows, "id bigint, city string, district string, rooms bigint, price_uah bigint, total_area double, building_type string, renovation_level string, published_at timestamp, lat double, lon double, cluster bigint, role string")
    whole = market.assess_samples(market.samples(t, t, now), now)
    assert rows_of(whole) == rows_of(market.assess(t, market.comparables(t, t, now), now)) and whole.count() == 61
    alone = whole.where("target = 99").first()
    assert (alone.n, alone.candidates, alone.stage, alone.status, alone.confidence_label) == (0, 0, None, "insufficient", "none")
    assert whole.where(F.col("status") == "ready").count() > 30
