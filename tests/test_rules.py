"""Texts, risks, sources and state against plain facts."""

import datetime
import hashlib
import tempfile

import pytest
from pyspark.sql import functions as F

DAY = datetime.datetime(2024, 1, 10)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://example.org/", "https://example.org/"),
        ("HTTP://User@Example.org:80//a//b/?b=2&UTM_Source=x&a=1&c=#f", "http://example.org/a/b?a=1&b=2"),
        ("http://example.org:443/a", "http://example.org:443/a"),
        ("https://example.org:443", "https://example.org/"),
        ("https://example.org/a?q=%D0%BA+x&ref=1", "https://example.org/a?q=%D0%BA+x&ref=1"),
        ("ftp://example.org/a", ""),
        ("not a url", ""),
        (None, ""),
    ],
)
def test_canonical_urls(spark, url, want):
    from dwellgraph.functions import text

    assert one(spark, text.canonical_url(F.lit(url).cast("string"))) == want


def test_texts(spark):
    from dwellgraph.functions import text

    assert one(spark, text.norm_text(F.lit("ВУЛ. Наукова, 10! Телефонуйте ﬁrst STRASSE ß 50 м²"))) == "вулиця наукова 10 first strasse ss 50 м²"
    tokens = one(spark, text.contact_tokens(F.lit("0671234567, +380671234567, A.b@Example.org @Some_one x@y 12345")))
    assert tokens == ["phone:380671234567", "email:a.b@example.org", "handle:some_one"]
    words = "дві слова і ще два слова".split()
    bits = [sum(1 if int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") >> b & 1 else -1 for w in words) for b in range(64)]
    want = f"{sum(1 << b for b in range(64) if bits[b] >= 0):016x}"
    assert one(spark, text.simhash64(F.lit(" ".join(words)))) == want and one(spark, text.simhash64(F.lit(""))) == ""
    assert one(spark, text.hamming64(F.lit("00000000000000ff"), F.lit("8000000000000000"))) == 9 and one(spark, text.hamming64(F.lit(""), F.lit("0" * 16))) == 64
    assert one(spark, text.text_similarity(F.lit("a b c"), F.lit("a b c"), F.lit("0" * 16), F.lit("0" * 16))) == 100.0
    assert one(spark, text.positive_numbers(F.lit("3, x, 0, 2,3,-1"))) == [3, 2]
    assert one(spark, text.optional_number(F.lit("x"))) is None and one(spark, text.clamp(F.lit(140))) == 100


def risky(spark, **changes):
    base = {
        "id": 1, "title": "Квартира", "description": "Світла квартира. " * 6, "city": "Львів", "district": "Ф", "street": "Н", "total_area": 40.0, "floor": 4, "commission_percent": 0, "is_owner": None, "hidden_commission": None,
        "deviation": None, "confidence_label": None, "market_status": None, "conflicts": None, "matches": None, "cluster_conflicts": None, "largest_change": None, "change_count": None,
    } | changes
    schema = "id int, title string, description string, city string, district string, street string, total_area double, floor int, commission_percent int, is_owner boolean, hidden_commission boolean, deviation double, confidence_label string, market_status string, conflicts array<string>, matches bigint, cluster_conflicts string, largest_change double, change_count bigint"
    return spark.createDataFrame([tuple(base.values())], schema)


@pytest.mark.parametrize(
    ("changes", "score", "level", "codes"),
    [
        ({}, 0, "low", ""),
        ({"deviation": -36.0, "confidence_label": "high", "market_status": "ready"}, 30, "review", "price_far_below_market"),
        ({"deviation": -36.0, "confidence_label": "low", "market_status": "ready"}, 0, "low", ""),
        ({"deviation": -20.0, "confidence_label": "medium", "market_status": "ready", "conflicts": ["rooms"], "matches": 2}, 56, "elevated", "price_below_market|duplicate_hard_conflict|images_reused_across_cities"),
        ({"description": "Терміново, без зайвих питань: передоплата https://x", "hidden_commission": True}, 64, "elevated", "hidden_commission_hint|short_description|prepayment_language|template_pressure_language|external_links_in_description"),
        ({"district": None, "street": "", "floor": None, "is_owner": None}, 8, "low", "missing_basic_fields"),
        ({"title": "Київ", "largest_change": 30.0, "change_count": 3, "cluster_conflicts": "price"}, 50, "elevated", "cluster_source_conflicts|sharp_price_change|frequent_price_changes|city_description_mismatch"),
        ({"is_owner": True, "description": "д" * 300}, 0, "low", ""),
    ],
)
def test_risks(spark, changes, score, level, codes):
    from dwellgraph.operators import risk

    got = risk.assess(risky(spark, **changes)).first()
    assert (got.score, got.level, got.codes) == (score, level, codes)
    assert got.protective == ("owner_declared|detailed_description" if changes.get("is_owner") else "")


def test_comparison_without_profile(spark):
    from dwellgraph.operators import rules

    rows = spark.createDataFrame([(1, "g", "a", None, 9000, 40.0), (2, "g", "b", None, 8000, None)], "id int, g string, title string, score bigint, price_uah int, total_area double")
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("commission_percent", "pets_allowed", "children_allowed", "heating_type", "renovation_level", "backup_power", "deposit_months")})
    got = rules.comparisons(rows, "g").first()
    assert got.recommended is None and not got.decisive and "'a'" in got.recommendation and "area" in got.unknowns.split(",")


def test_ingest_of_two_revisions(spark):
    from dwellgraph.sources.adapters import Request, Synthetic, ingest

    first = ingest(spark, Synthetic(), Request(limit=40), None, None, DAY)
    assert {r.status: r.n for r in first.counts.collect()} == {"created": 40} and first.landed.count() == 40
    again = ingest(spark, Synthetic(), Request(limit=40), first.landed, first.listings, DAY + datetime.timedelta(days=1))
    assert {r.status: r.n for r in again.counts.collect()} == {"unchanged": 40} and again.landed.count() == 0
    assert again.listings.where("last_seen_at = timestamp '2024-01-11'").count() == again.listings.count() == 40
    later = ingest(spark, Synthetic(), Request(limit=40, revision=2), first.landed, first.listings, DAY)
    assert {r.status: r.n for r in later.counts.collect()} == {"updated": 40} and later.landed.count() == 40
    for bad in ({"limit": 0}, {"limit": 1001}, {"revision": 21}):
        with pytest.raises(ValueError):
            Request(**bad)
    copies = Synthetic().search(spark, Request(limit=12)).where("attributes like '%demo_duplicate_group%'")
    assert copies.count() == 3 and copies.select("district", "rooms").distinct().count() == 1 and copies.select("title").distinct().count() == 3
    assert Synthetic().details(spark, Request(limit=12), "synthetic-0005").count() == 1 and Synthetic().details(spark, Request(limit=12), "synthetic-0013").count() == 0


def plainly_reused(old, new):
    """Clusters by their smallest members, each with the best old name that is left."""
    members, was = {}, {r.id: r.cluster for r in old.collect()}
    for r in new.collect():
        members.setdefault(r.cluster, []).append(r.id)
    out = {}
    for name in sorted(members, key=lambda c: min(members[c])):
        shared = {}
        for i in members[name]:
            if i in was and was[i] not in out.values():
                shared[was[i]] = shared.get(was[i], 0) + 1
        out[name] = min(shared, key=lambda c: (-shared[c], c)) if shared else name
    return out


def test_names_go_on_as_one_after_the_other(spark):
    import random

    from dwellgraph.operators import duplicates

    rng = random.Random(1)
    old = spark.createDataFrame([(rng.randrange(12), i) for i in range(100, 220)], "cluster bigint, id bigint")
    groups = [rng.randrange(25) for _ in range(130)]
    first = {}
    for i, g in zip(range(100, 230), groups):
        first.setdefault(g, i)
    new = spark.createDataFrame([(first[g], i) for i, g in zip(range(100, 230), groups)], "cluster bigint, id bigint")
    assert {r.cluster: r.kept for r in duplicates.reused_ids(old, new).collect()} == plainly_reused(old, new)


def test_clusters_go_on(spark):
    from dwellgraph.operators import duplicates

    old = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 20), (2, 21), (3, 30)], "cluster bigint, id bigint")
    new = spark.createDataFrame([(10, 10), (10, 11), (12, 12), (12, 20), (12, 21), (40, 40)], "cluster bigint, id bigint")
    kept = duplicates.reused_ids(old, new)
    assert {r.cluster: r.kept for r in kept.collect()} == {10: 1, 12: 2, 40: 40}
    assert [r.cluster for r in duplicates.archived(old, kept).collect()] == [3]
    # The loser of a first choice has its second: 50 takes 7, so 60 goes on as 8, and 70 has none left but its own.
    was = spark.createDataFrame([(7, i) for i in (50, 51, 60, 61, 62, 70)] + [(8, 63), (8, 64)], "cluster bigint, id bigint")
    now = spark.createDataFrame([(50, 50), (50, 51), (60, 60), (60, 61), (60, 62), (60, 63), (70, 70), (70, 64)], "cluster bigint, id bigint")
    assert {r.cluster: r.kept for r in duplicates.reused_ids(was, now).collect()} == plainly_reused(was, now) == {50: 7, 60: 8, 70: 70}
    roles = lambda rows, *primary: rows.withColumn("role", F.when(F.col("id").isin(*primary), "primary").otherwise("duplicate"))
    states = spark.createDataFrame([(1, 1, True, False, True, "x", DAY), (1, 2, False, True, True, "y", DAY), (1, 3, True, True, True, "z", DAY), (2, 1, False, False, True, "w", DAY)], "user_id int, cluster bigint, is_favorite boolean, is_hidden boolean, is_compared boolean, note string, updated_at timestamp")
    got = duplicates.migrated_states(states, roles(old, 12, 20, 30), roles(new, 10, 12, 40), kept).collect()
    assert sorted((r.user_id, r.cluster, r.is_favorite, r.is_hidden, r.is_compared, r.note) for r in got) == [(1, 1, True, False, True, "x"), (1, 2, True, False, True, "x"), (2, 1, False, False, True, "w"), (2, 2, False, False, True, "w")]
    scored = spark.createDataFrame([(1, 2, 95.0, "auto_merge"), (2, 3, 80.0, "needs_review")], "left_id bigint, right_id bigint, final double, decision string")
    log = spark.createDataFrame([(1, 2, 1, "confirmed", DAY), (2, 1, 2, "split", DAY + datetime.timedelta(1)), (3, 3, 2, "confirmed", DAY)], "id bigint, left_id bigint, right_id bigint, decision string, decided_at timestamp")
    assert {(r.left_id, r.right_id): r.decision for r in duplicates.with_manual(scored, log).collect()} == {(1, 2): "split", (2, 3): "confirmed"}


def test_refreshes(spark):
    from dwellgraph.operators import state

    hour = datetime.timedelta(hours=1)
    rows = spark.createDataFrame([(1, DAY), (2, DAY), (3, DAY + 2 * hour), (4, DAY)], "id int, updated_at timestamp")
    made = spark.createDataFrame([(1, DAY + hour, DAY + 3 * hour), (2, DAY + hour, None), (3, DAY + hour, None)], "id int, calculated_at timestamp, valid_until timestamp")
    assert [r.id for r in state.to_refresh(rows, made, DAY + 4 * hour, limit=10).collect()] == [4, 1, 3]
    assert [r.id for r in state.to_refresh(rows, made, DAY + 4 * hour, limit=0).collect()] == [4]
    known = spark.createDataFrame([(1, "a", None), (2, "b", DAY)], "id int, digest string, valid_until timestamp")
    asked = spark.createDataFrame([(1, "a"), (1, "x"), (2, "b")], "id int, digest string")
    assert sorted((r.id, r.digest, r.action) for r in state.refreshed(asked, known, DAY + hour).collect()) == [(1, "a", "reuse"), (1, "x", "compute"), (2, "b", "compute")]
    with pytest.raises(ValueError):
        state.ordered(rows, "random")
    assert state.owned(rows.withColumn("user_id", F.lit(3)), 3).count() == 4
    assert one(spark, state.local_midnight(F.lit("2024-01-15 12:00:00").cast("timestamp")).cast("string")) == "2024-01-14 22:00:00"


def test_stream_hands_over_changed_keys(spark):
    from dwellgraph.streaming import streams

    top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame([(1,), (1,), (2,)], "id int").write.parquet(f"{top}/in")
    seen = []
    streams.refresh_on_change(spark.readStream.schema("id int").parquet(f"{top}/in"), lambda keys, number: seen.append((number, sorted(r.id for r in keys.collect()))), f"{top}/state")
    assert seen == [(0, [1, 2])]
