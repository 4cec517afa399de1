"""Incremental detection against a full one, the versioned table, and manual decisions."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

LISTING = "id bigint, source_code string, external_id string, city string, district string, street string, deal_type string, property_type string, rooms bigint, total_area bigint, floor bigint, floors_total bigint, building_type string, renovation_level string, heating_type string, price_uah bigint, lat double, lon double, location_accuracy string, title string, description string, image_one string, image_two string, perceptual string, is_active boolean, legal_status string, enabled boolean, health_status string, pets_allowed boolean, children_allowed boolean, is_owner boolean, commission_percent bigint, published_at timestamp"


def listing(rng, i):
    flat = rng.randrange(12)
    return (i, f"s{i % 3}", f"x{i}", rng.choice(["Львів", "Київ"]), f"d{flat % 2}", f"вулиця {flat}", "rent", "apartment", 1 + flat % 2 + (rng.random() < 0.1), 40 + flat, 3, 9, "brick", "modern", "gas", 10_000 + 400 * flat + rng.randrange(3) * 300,
        49.8 + flat / 500, 24.0, "building", f"квартира {flat}", f"опис {flat} дзвоніть 067{1000000 + flat * 7 + rng.randrange(2)}", f"https://e.org/{flat}.jpg", f"https://e.org/b{rng.randrange(30)}.jpg", None, True, "approved", True, "healthy", True, None, bool(flat % 2), 50, datetime.datetime(2024, 1, 1 + i % 20))


def told(d):
    of = lambda rows, *c: sorted(map(tuple, rows.select(*c).collect()))
    return of(d.prints, "id", "address_key"), of(d.scored, "left_id", "right_id", "final", "decision"), of(d.components, "id", "component"), of(d.clusters, "id", "cluster")


@pytest.mark.parametrize("seed", [1, 2])
def test_incremental_equals_full(spark, seed):
    """Insertions, changes and deletions, with a small cap, so that listings enter and leave the first of a city."""
    from dwellgraph.operators import incremental as inc

    rng = random.Random(seed)
    rows = {i: listing(rng, i) for i in range(10, 80)}
    frame = lambda: spark.createDataFrame(list(rows.values()), LISTING)
    options = {"cap": 12, "text": False}
    log = spark.createDataFrame([(1, 11, 10, "split", datetime.datetime(2024, 1, 1)), (2, 20, 30, "confirmed", datetime.datetime(2024, 1, 2))], "id bigint, left_id bigint, right_id bigint, decision string, decided_at timestamp")
    state = inc.detect(frame(), log=log, **options)
    changed = set()
    for i in rng.sample(sorted(rows), 4):
        del rows[i]
        changed.add(i)
    for i in [1, 90, *rng.sample(sorted(rows), 3)]:
        rows[i] = listing(rng, i)
        changed.add(i)
    more = log.union(spark.createDataFrame([(3, 10, 11, "restored", datetime.datetime(2024, 1, 3))], log.schema))
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "id bigint")
    now = inc.redetect(state, frame(), ids(changed), log=more, reviewed=ids([10, 11]), **options)
    full = inc.detect(frame(), log=more, **options)
    assert told(now) == told(full) and told(now)[3] and told(now)[1] != told(state)[1]
    if seed == 1:
        rows[95] = listing(rng, 95)
        city = inc.rebuild_city(now, frame(), rows[95][3].upper(), log=more, **options)
        assert told(city) == told(inc.detect(frame(), log=more, **options))


def test_pairs_without_a_cap_are_all_pairs(spark):
    from dwellgraph.operators import duplicates

    prints = spark.createDataFrame([(i, "c", "", [], "a", "", "", 1, ["h"], "") for i in range(30)], "id bigint, city_key string, url_key string, contacts array<string>, address_key string, geo_key string, attribute_key string, price_bucket bigint, exact array<string>, text_block string")
    assert duplicates.block_pairs(prints, cap=None, text=False).count() == 435
    assert duplicates.block_pairs(prints, cap=2, text=False).count() == 29 + 28
    only = spark.createDataFrame([(1,), (7,)], "id bigint")
    assert duplicates.block_pairs(prints, cap=2, text=False, only=only).count() == 29 + 1
    assert duplicates.block_pairs(prints, cap=None, text=False, only=only).count() == 29 + 28


def table_at(spark, path):
    from pyspark.sql.types import StructType

    from dwellgraph.sources.versioned import VersionedTable

    return VersionedTable(spark, path, StructType.fromDDL("k bigint, v string, n int"), ("k",))


def test_versions(spark, tmp_path):
    t = table_at(spark, str(tmp_path / "t"))
    rows = lambda x: spark.createDataFrame(x, "k bigint, v string, n int")
    now = lambda v=None: sorted(tuple(r) for r in t.read(v).collect())
    assert now() == []
    assert t.apply("a", rows([(1, "x", 1), (2, "y", 1)])) == 1
    assert t.apply("b", rows([(2, "z", 2), (3, None, 2), (3, "w", 1)]), deleted=rows([(1, "", 0), (9, "", 0)]), order=["n"]) == 2
    want = [(2, "z", 2), (3, None, 2)]
    assert now() == want and t.apply("b", rows([(7, "never", 0)])) == 2 and now() == want
    # One that fails half way leaves nothing behind, and can be applied again.
    for bad in (rows([(5, "p", 1), (5, "q", 1)]), rows([(None, "p", 1)])):
        with pytest.raises(Exception, match="key"):
            t.apply("c", bad)
    broken = rows([(1, "a", 1), (4, "b", 1)]).withColumn("v", F.when(F.col("k") == 4, F.raise_error(F.lit("half way"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="half way"):
        t.apply("c", broken)
    assert now() == want and t.apply("c", rows([(1, "again", 3)])) == 3
    after = now()
    assert after == [(1, "again", 3), *want] and t.compact() == 4 and now() == after and now(2) == want and now(1) == [(1, "x", 1), (2, "y", 1)] and now(0) == []
    t.apply("d", rows([]), deleted=rows([(2, "", 0)]))
    assert now() == [(1, "again", 3), (3, None, 2)]


def test_stream_into_versions_replays(spark, tmp_path):
    t = table_at(spark, str(tmp_path / "t"))
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "k bigint, v string, n int").write.parquet(source)
    stream = lambda: spark.readStream.schema(t.schema).parquet(source)
    t.sink(stream(), str(tmp_path / "state"), order=["n"])
    spark.createDataFrame([(2, "c", 1)], "k bigint, v string, n int").write.mode("append").parquet(source)
    t.sink(stream(), str(tmp_path / "state"), order=["n"])
    t.sink(stream(), str(tmp_path / "state"), order=["n"])
    assert sorted(map(tuple, t.read().collect())) == [(1, "b", 2), (2, "c", 1)] and len(t.manifest()) == 2


def test_reviews_win_and_can_be_undone(spark):
    from dwellgraph.operators import duplicates

    day = lambda n: datetime.datetime(2024, 1, n)
    asked = spark.createDataFrame([(1, 2, 1, "confirm", "ann", None, day(1)), (2, 1, 2, "block_pair", "bob", "n" * 2000, day(2)), (3, 3, 4, "block_pair", "bob", "", day(1)), (4, 4, 3, "restore_auto", "ann", "", day(3))], "id bigint, left_id bigint, right_id bigint, action string, actor string, note string, decided_at timestamp")
    log = duplicates.reviews(asked)
    assert [(r.left_id, r.right_id, r.decision, len(r.note)) for r in log.orderBy("id").collect()] == [(1, 2, "confirmed", 0), (1, 2, "split", 1000), (3, 4, "split", 0), (3, 4, "restored", 0)]
    scored = spark.createDataFrame([(1, 2, "auto_merge"), (3, 4, "auto_merge"), (5, 6, "rejected")], "left_id bigint, right_id bigint, decision string")
    assert sorted(map(tuple, duplicates.with_manual(scored, log).collect())) == [(1, 2, "split"), (3, 4, "auto_merge"), (5, 6, "rejected")]
    for action, right in (("other", 2), ("confirm", 1)):
        with pytest.raises(Exception, match="action|itself"):
            duplicates.reviews(asked.limit(1).withColumns({"action": F.lit(action), "left_id": F.lit(1), "right_id": F.lit(right)})).collect()
