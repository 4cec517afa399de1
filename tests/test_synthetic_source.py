"""The synthetic data source: options, partitions, pushed filters, streams that go on, and what ingestion makes of it."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from dwellgraph.sources import synthetic as s


@pytest.fixture(scope="module")
def read(spark):
    s.register(spark)
    return lambda **o: spark.read.format(s.NAME).options(**o).load()


def test_rows_and_partitions(read):
    whole = read(limit=100, pages=3)
    assert whole.rdd.getNumPartitions() == 3 and whole.count() == 300 and len(whole.columns) == 26
    rows = {r.external_id: r for r in whole.collect()}
    assert [tuple(r) for r in read(limit=300).orderBy("external_id").collect()] == [tuple(rows[k]) for k in sorted(rows)]
    copies = [rows[f"synthetic-{n:04d}"] for n in (13, 14, 15)]
    same = lambda c: len({r[c] for r in copies}) == 1
    assert all(map(same, ("city", "district", "street", "rooms", "total_area", "latitude", "floor"))) and len({r.title for r in copies}) == 3
    assert len({json.loads(r.attributes)["demo_duplicate_group"] for r in copies}) == 1 and not same("price")
    assert all(28 + 7 * r.rooms <= r.total_area <= 42 + 18 * r.rooms and 1 <= r.floor <= r.floors_total and r.price >= 6000 for r in rows.values())
    assert {r.city for r in rows.values()} == set(s.CITIES) and all(r.district in s.DISTRICTS[r.city] for r in rows.values())
    other = {r.external_id: r for r in read(limit=300, seed=1).collect()}
    assert sum(other[k].total_area != rows[k].total_area for k in rows) > 200


def test_revisions_change_prices(read):
    first, second, third = ({r.external_id: r.price for r in read(limit=200, revision=n).collect()} for n in (1, 2, 3))
    number = lambda k: int(k[-4:]) - 1
    assert {number(k) % 20 for k in first if second[k] != first[k]} == {0, 1}
    assert all(number(k) % 45 == 0 for k in first if third[k] != second[k]) and third["synthetic-0046"] < second["synthetic-0046"]


def test_filters_are_pushed(read):
    found = read(limit=100, pages=50).where((F.col("external_id") == "synthetic-0321") & (F.col("price") > 0))
    assert found.rdd.getNumPartitions() == 1 and [r.external_id for r in found.collect()] == ["synthetic-0321"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any("Filter (" in line and "synthetic-0321" in line for line in plan.split("\n"))
    assert read(limit=100).where("external_id in ('synthetic-0001', 'synthetic-1', 'x', 'synthetic-0002')").count() == 2
    cities = read(limit=100).where("city = 'Київ' and rooms = 2")
    assert cities.count() == sum(r.city == "Київ" and r.rooms == 2 for r in read(limit=100).collect()) > 0
    assert read(limit=10).where("external_id = 'none'").count() == 0


@pytest.mark.parametrize("bad", [{"limit": 0}, {"limit": 1001}, {"revision": 0}, {"revision": 21}, {"pages": 0}])
def test_bounds(read, bad):
    with pytest.raises(Exception, match="is from 1|or more"):
        read(**bad).count()


def test_stream_goes_on_from_its_offset(spark, read, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run(revision):
        stream = spark.readStream.format(s.NAME).options(limit=20, pages=2, revision=revision).load()
        stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        return {r.revision: r.n for r in spark.read.parquet(out).groupBy("revision").agg(F.count("*").alias("n")).collect()}

    assert run(1) == {1: 40}
    assert run(3) == {1: 40, 2: 40, 3: 40} and run(3) == {1: 40, 2: 40, 3: 40}


def test_ingest_marks_and_defaults(spark):
    from dwellgraph.sources.adapters import Health, Request, Synthetic, ingest

    day = datetime.datetime(2024, 1, 10)

    class Broken(Synthetic):
        code = "broken"

        def search(self, spark, request):
            raw = super().search(spark, request)
            worse = F.when(F.col("external_id") == "synthetic-0003", F.lit(None)).otherwise(F.col("price"))
            return raw.withColumns({"price": worse.cast("bigint"), "title": F.when(F.col("external_id") == "synthetic-0004", " ").otherwise(F.col("title")), "district": F.lit(None).cast("string")})

    class Down(Synthetic):
        def health(self):
            return Health(False, "no answer")

    good = ingest(spark, Synthetic(), Request(limit=10), None, None, day)
    assert good.status == "healthy" and len(good.listings.columns) >= 30
    both = ingest(spark, Broken(), Request(limit=10), good.landed, good.listings, day)
    assert both.status == "degraded" and both.quarantined.count() == 2 and both.listings.count() == 18
    assert {r.source_code: r.n for r in both.listings.groupBy("source_code").agg(F.count("*").alias("n")).collect()} == {"synthetic": 10, "broken": 8}
    assert both.listings.where("source_code = 'broken' and district <> ''").count() == 0
    with pytest.raises(ConnectionError):
        ingest(spark, Down(), Request(limit=10), None, None, day)
