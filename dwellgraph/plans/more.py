"""More registered queries: geography, state, snapshots and small expressions, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dwellgraph.functions import geo, nested, text
from dwellgraph.operators import detail, fingerprints, history, incremental, market, matching, risk, state
from dwellgraph.operators.lineage import shared_folder
from dwellgraph.plans import catalogue
from dwellgraph.plans.catalogue import ASSESSED, HAVERSINE, PAIRS, PLACES, SCORED, L, approved, query, table
from dwellgraph.sources.listings import LISTINGS_SQL, fixture_listings
from dwellgraph.sources.versioned import VersionedTable
from dwellgraph.streaming import rules as stream_rules

_PLACES = "p(name, plon, plat) as (values ('centre', 24.2::double, 48.6::double), ('station', 24.35::double, 49.3::double))"


# Geography


@query(L + f", {_PLACES} select name place, id, round({HAVERSINE.format('plon', 'plat')} / 1000, 2) km from a cross join p where {HAVERSINE.format('plon', 'plat')} <= 12000")
def spatial_range_join(spark, d):
    places = spark.createDataFrame(PLACES, "place string, lon double, lat double")
    return geo.within(approved(spark, d), places, 12.0)


@query(L + " select city, min(lon) west, min(lat) south, max(lon) east, max(lat) north from a group by city")
def city_bounds(spark, d):
    return geo.bounds(approved(spark, d), "city")


@query(L + """ select id, '{"type":"Feature","id":' || id || ',"geometry":{"type":"Point","coordinates":[' || round(lon, 3) || ',' || round(lat, 3) || ']},"properties":{"price_uah":' || price_uah || ',"rooms":' || rooms || '}}' feature from a""")
def geojson_features(spark, d):
    rows = approved(spark, d).withColumns({"lat": F.round("lat", 3), "lon": F.round("lon", 3)})
    return geo.features(rows, ["price_uah", "rooms"])


# State


@query("""select event_id id, user_id::varchar as "key", ts as "at", exists (select 1 from events r where r.event_type = 'view' and r.user_id = q.user_id and r.ts <= q.ts and r.ts > q.ts - interval 3600 second) hit from events q where event_type = 'click'""")
def cache_hits(spark, d):
    events = table(spark, d, "events").withColumn("key", F.col("user_id").cast("string"))
    asked = events.where("event_type = 'click'").select(F.col("event_id").alias("id"), "key", F.col("ts").alias("at"))
    return state.cached(asked, events.where("event_type = 'view'").select("key", F.col("ts").alias("made_at")), ttl_seconds=3600)


@query("""with r as (select *, sum((event_type <> 'error')::int) over (partition by user_id order by ts, event_id) run from events),
  s as (select *, sum((event_type = 'error')::int) over (partition by user_id, run order by ts, event_id) streak from r)
  select event_id, streak, event_type = 'error' and streak >= 2 tripped, case when event_type = 'error' and streak >= 2 then ts + interval 60 second end open_until from s""")
def circuit_breaker(spark, d):
    calls = table(spark, d, "events").withColumn("failed", F.col("event_type") == "error")
    return state.breaker(calls, key="user_id", at="ts", tie="event_id", failed="failed", limit=2, pause_seconds=60).select("event_id", "streak", "tripped", "open_until")


@query("select user_id, event_id id, row_number() over (partition by user_id order by ts, event_id) <= 4 allowed from events where event_type = 'view'")
def compare_limit(spark, d):
    marks = table(spark, d, "events").where("event_type = 'view'").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("updated_at"), F.lit(True).alias("is_compared"))
    return state.compared(marks, most=4)


def _sequential(answer: str, start: str, step: str) -> str:
    """SQL of a rule that decides a user's events one after the other: answer and state of a row by those of the row before."""
    return f"""with recursive e as (select *, epoch_us(ts) t, (event_type = 'error')::int flag, row_number() over (partition by user_id order by ts, event_id) rn from events),
  r as (select user_id, rn, event_id, {start} from e where rn = 1 union all select e.user_id, e.rn, e.event_id, {step} from r join e on e.user_id = r.user_id and e.rn = r.rn + 1)
  select event_id, {answer} answer from r"""


def _decided(spark, d, rule):
    events = table(spark, d, "events").withColumns({"failed": (F.col("event_type") == "error").cast("int"), "sent": F.unix_micros(F.col("ts").cast("timestamp")) - F.col("event_id") % 11 * 400_000_000 + 40_000_000})
    flag = "sent" if isinstance(rule, stream_rules.Replay) else "failed"
    return stream_rules.decided(events, rule, key="user_id", at="ts", tie="event_id", flag=flag).select(F.col("tie").alias("event_id"), "answer")


_HOURS = 3_600_000_000
_AGE = "e.event_id % 11 * 400000000 - 40000000"
_FIRST = _AGE.replace("e.event_id", "event_id")
_fresh = lambda age, rest: f"case when {age} > 3600000000 then 'expired' when {age} < -30000000 then 'future' else {rest} end"


@query(_sequential("answer", f"{_fresh(_FIRST, repr('accepted'))} answer, case when {_fresh(_FIRST, repr('accepted'))} = 'accepted' then t + {6 * _HOURS} else 0 end until", f"{_fresh(_AGE, 'case when e.t < r.until then ' + repr('replayed') + ' else ' + repr('accepted') + ' end')}, case when {_fresh(_AGE, 'case when e.t < r.until then 1::varchar else 0::varchar end')} = '0' then e.t + {6 * _HOURS} else r.until end"))
def replay_window(spark, d):
    return _decided(spark, d, stream_rules.Replay(ttl_seconds=6 * 3600))


@query(_sequential("answer", f"case when flag = 1 then 'failure' else 'success' end answer, flag failures, case when flag = 1 then t + {8 * _HOURS} else 0 end until, 0::bigint opened",
    f"case when e.t < r.opened then 'refused' when e.flag = 0 then 'success' when case when e.t < r.until then r.failures else 0 end + 1 >= 2 then 'tripped' else 'failure' end, case when e.t < r.opened then r.failures when e.flag = 0 then 0 else case when e.t < r.until then r.failures else 0 end + 1 end, case when e.t < r.opened then r.until when e.flag = 0 then 0 else e.t + {8 * _HOURS} end, case when e.t < r.opened then r.opened when e.flag = 1 and case when e.t < r.until then r.failures else 0 end + 1 >= 2 then e.t + {8 * _HOURS} else 0 end"))
def breaker_ttl(spark, d):
    return _decided(spark, d, stream_rules.Breaker(limit=2, pause_seconds=8 * 3600))


@query(_sequential("answer", "'granted' answer, [t] recent", f"case when len(list_filter(r.recent, lambda x: x > e.t - {24 * _HOURS})) >= 3 then 'refused' else 'granted' end, case when len(list_filter(r.recent, lambda x: x > e.t - {24 * _HOURS})) >= 3 then list_filter(r.recent, lambda x: x > e.t - {24 * _HOURS}) else list_append(list_filter(r.recent, lambda x: x > e.t - {24 * _HOURS}), e.t) end"))
def rate_slots(spark, d):
    return _decided(spark, d, stream_rules.Rate(limit=3, per_seconds=24 * 3600))


@query("with f as (select event_id, (event_id * 7919) % 400 k, ts from events), s as (select distinct k from f where event_id < 100) select k, min_by(event_id, [epoch_us(ts), event_id]) event_id from f where event_id >= 100 and k not in (select k from s) group by k")
def replay_protection(spark, d):
    rows = table(spark, d, "events").select("event_id", (F.col("event_id") * 7919 % 400).alias("k"), "ts")
    return state.accepted_once(rows.where("event_id >= 100"), rows.where("event_id < 100"), key="k", at="ts", tie="event_id").select("k", "event_id")


@query(L + " select id, price_uah from a order by price_uah desc, id limit 50")
def feed_ordered(spark, d):
    return state.ordered(approved(spark, d), "price_desc").select("id", "price_uah").limit(50)


@query("""with t(id, place) as (values (33, 0), (7, 1), (3, 2), (1, 3)), l as (select o_orderkey id, o_orderstatus status from orders) select l.id, status, place from l join t using (id)""")
def fetch_in_order(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return state.in_order(rows, [33, 7, 3, 7, 1])


@query(L + """, g as (select *, case when id % 4 < 3 then id // 4 end cluster, case when id % 4 = 0 then 'primary' when id % 4 < 3 then 'duplicate' end as role from a),
  s as (select distinct 1 + event_id % 997 id, event_type = 'error' hidden, event_type = 'click' fav from events),
  h as (select coalesce('c' || cluster, 'l' || s.id) subject, max(hidden) is_hidden, max(fav) is_favorite from s left join (select id, case when id % 4 < 3 then id // 4 end cluster from l) c using (id) group by 1)
  select g.id, coalesce(is_favorite, false) is_favorite from g left join h on h.subject = coalesce('c' || g.cluster, 'l' || g.id) where (g.role is null or g.role = 'primary') and not coalesce(is_hidden, false)""")
def feed_by_cluster(spark, d):
    from dwellgraph.sources.listings import fixture_listings

    clusters = fixture_listings(spark, d).where("id % 4 < 3").select(F.expr("id div 4").alias("cluster"), "id", F.when(F.col("id") % 4 == 0, "primary").otherwise("duplicate").alias("role"))
    marks = table(spark, d, "events").select((1 + F.col("event_id") % 997).alias("id"), (F.col("event_type") == "click").alias("is_favorite"), (F.col("event_type") == "error").alias("is_hidden"))
    return state.feed(approved(spark, d), clusters, marks).select("id", "is_favorite")


@query("select user_id, round(sum(value), 6) spent, sum(value) < 60 allowed from events where event_type = 'purchase' and value is not null and ts >= timestamp '2024-01-14 22:00:00' and ts <= timestamp '2024-01-15 12:00:00' group by user_id")
def budget_daily(spark, d):
    log = table(spark, d, "events").where("value is not null").select("user_id", F.col("ts").alias("created_at"), F.col("value").alias("cost"), F.when(F.col("event_type") == "purchase", "success").otherwise("other").alias("status"))
    return state.spent_today(log, F.lit("2024-01-15 12:00:00").cast("timestamp"), limit=60)


@query("""with e as (select user_id id, event_id, ts, row_number() over (partition by user_id order by ts desc, event_id desc) k, case when event_type = 'error' then 'failed' else 'ready' end status, case when event_id % 3 > 0 then ts + interval 6 hour end valid_until from events)
  select id, event_id from e where k = 1 and status = 'ready' and (valid_until is null or valid_until > timestamp '2024-01-30 00:00:00')""")
def validated_context(spark, d):
    made = table(spark, d, "events").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("assessment_id"), F.col("ts").alias("calculated_at"), F.when(F.col("event_type") == "error", "failed").otherwise("ready").alias("status"),
        F.when(F.col("event_id") % 3 > 0, F.col("ts") + F.expr("interval 6 hours")).alias("valid_until"),
    )
    as_of = F.lit("2024-01-30 00:00:00").cast("timestamp")
    return risk.valid_context(made, as_of).select("id", F.col("assessment_id").alias("event_id"))


@query("""with o as (select max(o_orderdate)::date as_of from orders), a as (select o_orderkey id, as_of - o_orderdate::date age_days, o_orderstatus <> 'P' and as_of - o_orderdate::date <= 400 is_active from orders, o) select id, age_days::int age_days, is_active from a""")
def stale_sweep(spark, d):
    orders = table(spark, d, "orders")
    newest = orders.agg(F.max("o_orderdate")).first()[0]
    rows = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("last_seen_at"), (F.col("o_orderstatus") != "P").alias("is_active"))
    return history.swept(rows, newest, days=400).select("id", "age_days", "is_active")


_DETAIL = L + """, mb as (select a.*, case when id % 4 < 3 then id // 4 end cluster, case when id % 4 = 0 then 'primary' when id % 4 < 3 then 'duplicate' end as role, (90 - id % 7)::bigint confidence from a),
  gr as (select cluster, count(*) member_count, count(distinct source_code) source_count, min(price_uah) price_min, max(price_uah) price_max, list({'id': id, 'role': role, 'source_code': source_code, 'price_uah': price_uah, 'joined_by': 'auto'} order by role <> 'primary', confidence desc, published_at desc, id) members from mb where cluster is not null group by cluster),
  st as (select id, list({'user_id': user_id, 'is_favorite': fav, 'is_hidden': hid, 'is_compared': cmp} order by user_id) states from (select 1 + event_id % 997 id, user_id, bool_or(event_type = 'click') fav, bool_or(event_type = 'error') hid, bool_or(event_type = 'view') cmp from events group by all) group by id),
  sm as (select id, list({'kind': kind, 'status': status} order by kind) assessments from (select 1 + event_id % 997 id, case when event_id % 2 = 0 then 'market' else 'risk' end kind, arg_max(case when event_type = 'error' then 'failed' else 'ready' end, event_id) status from events group by 1, 2) group by id),
  hi as (select id, list({'at': "at", 'price': price} order by "at", price) history from (select l_orderkey id, strftime(l_shipdate, '%Y-%m-%d') "at", round(l_extendedprice)::bigint price from lineitem) group by id)
  select mb.id, mb.cluster, coalesce(role = 'primary', true) is_cluster_primary, coalesce(member_count, 1) member_count, coalesce(source_count, 1) source_count, case when mb.cluster is null then price_uah else price_min end price_min, case when mb.cluster is null then price_uah else price_max end price_max,
    coalesce(to_json(members)::varchar, '[]') members, coalesce(to_json(states)::varchar, '[]') states, coalesce(to_json(assessments)::varchar, '[]') assessments, coalesce(to_json(history)::varchar, '[]') history
  from mb left join gr on mb.cluster = gr.cluster left join st using (id) left join sm using (id) left join hi using (id)"""


@query(_DETAIL)
def listing_detail(spark, d):
    rows = approved(spark, d)
    role = F.when(F.col("id") % 4 == 0, "primary").otherwise("duplicate")
    members = rows.where("id % 4 < 3").select(F.expr("id div 4").alias("cluster"), "id", role.alias("role"), (90 - F.col("id") % 7).alias("confidence"), F.lit("auto").alias("joined_by"))
    events = table(spark, d, "events").withColumn("id", 1 + F.col("event_id") % 997)
    on = lambda kind: F.bool_or(F.col("event_type") == kind)
    states = events.groupBy("id", "user_id").agg(on("click").alias("is_favorite"), on("error").alias("is_hidden"), on("view").alias("is_compared"))
    made = events.select("id", F.when(F.col("event_id") % 2 == 0, "market").otherwise("risk").alias("kind"), F.when(F.col("event_type") == "error", "failed").otherwise("ready").alias("status"), F.col("event_id").alias("calculated_at"), F.lit(None).cast("timestamp").alias("valid_until"))
    history = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("at"), F.round("l_extendedprice").cast("bigint").alias("price"))
    told = detail.listing_detail(rows, members, states, made, history)
    return told.select("id", "cluster", "is_cluster_primary", "member_count", "source_count", "price_min", "price_max", *[F.to_json(c).alias(c) for c in ("members", "states", "assessments", "history")])


@query("select user_id, event_id id, place from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id) place from events where event_type = 'click') where place <= 4")
def recent_four(spark, d):
    marks = table(spark, d, "events").where("event_type = 'click'").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("updated_at"))
    return state.recent(marks).select("user_id", "id", "place")


# Snapshots and small expressions


@query("""with s as (select l_orderkey id, round(l_extendedprice)::bigint price_uah, l_returnflag flag, l_linestatus title, l_shipdate captured_at from lineitem),
  h as (select id, captured_at, sha256('{"flag":"' || flag || '","price_uah":' || price_uah || ',"title_hash":"' || sha256(trim(title)) || '"}') content_hash from s)
  select id, content_hash, min(captured_at) captured_at from h group by id, content_hash""")
def snapshot_states(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.round("l_extendedprice").cast("bigint").alias("price_uah"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("title"), F.col("l_shipdate").alias("captured_at"))
    return history.snapshots(rows, ["flag", "price_uah"], texts=("title",)).select("id", "content_hash", "captured_at")


@query("select x.p_partkey id, bit_count(xor(('0x' || substr(md5(x.p_name), 1, 8))::bigint, ('0x' || substr(md5(y.p_name), 1, 8))::bigint)) + bit_count(xor(('0x' || substr(md5(x.p_name), 9, 8))::bigint, ('0x' || substr(md5(y.p_name), 9, 8))::bigint)) bits from part x join part y on y.p_partkey = x.p_partkey + 1")
def hamming_pairs(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.substring(F.md5("p_name"), 1, 16).alias("h"))
    nxt = parts.select((F.col("id") - 1).alias("id"), F.col("h").alias("other"))
    return parts.join(nxt, "id").select("id", text.hamming64(F.col("h"), F.col("other")).cast("bigint").alias("bits"))


@query(L + " select id, case when total_area > 0 then ((200 * price_uah + total_area) // (2 * total_area)) / 100 end per_area from a")
def price_per_area(spark, d):
    from dwellgraph.operators.market import price_per_area as per_area

    return approved(spark, d).select("id", per_area(F.col("price_uah"), F.col("total_area")).alias("per_area"))


@query("select event_id, array_to_string(list_filter(case when event_id % 7 = event_id % 5 then [event_id % 7, 12] else [event_id % 7, event_id % 5, 12] end, lambda x: x > 0), ',') numbers from events")
def positive_number_lists(spark, d):
    rows = table(spark, d, "events").select("event_id", F.concat_ws(",", F.col("event_id") % 7, F.lit("x"), F.lit(" "), F.col("event_id") % 5, F.lit(" 12"), F.lit("-3"), F.lit("12")).alias("csv"))
    return rows.select("event_id", F.array_join(text.positive_numbers(F.col("csv")), ",").alias("numbers"))


@query(L + " select id, concat_ws(', ', nullif(trim(building_type), ''), nullif(trim(renovation_level), ''), nullif(trim(city), '')) address from a")
def joined_address(spark, d):
    return approved(spark, d).select("id", text.joined_parts(F.col("building_type"), F.col("renovation_level"), F.col("city")).alias("address"))


# Nested payloads, versions, small rules


@query("select l.id id, lower(regexp_replace(regexp_replace(j.fullkey[2:], '\\[[0-9]+\\]', '', 'g'), '\"', '', 'g')) path, j.atom ->> '$' \"value\" from (" + LISTINGS_SQL + ") l, json_tree(case when json_valid(attributes) then attributes end) j where j.type = 'VARCHAR'")
def attribute_texts(spark, d):
    return nested.strings(fixture_listings(spark, d), "id", "attributes")


_ALLOWED = ", ".join(f"case when json_exists(attributes, '$.{k}') then '{k}' end" for k in sorted(history.ALLOWED))


@query(L + f" select id, case when json_valid(attributes) then concat_ws(',', {_ALLOWED}) else '' end allowed from a")
def allowed_attributes(spark, d):
    kept = history.allowed(F.from_json("attributes", "map<string,string>"))
    return approved(spark, d).select("id", F.array_join(F.map_keys(kept), ",").alias("allowed"))


@query(L + " select id from a where id % 7 = 0 or id % 3 <> 1 or id % 5 = 2 or published_at - interval 3 day * (id % 2) < published_at")
def stale_fingerprints(spark, d):
    rows = approved(spark, d)
    made = rows.where("id % 7 <> 0").select("id", (F.col("id") % 3).alias("version"), F.when(F.col("id") % 5 == 2, 1).otherwise(2).alias("image_version"), F.expr("published_at - make_dt_interval(3 * (id % 2))").alias("computed_at"))
    return fingerprints.stale(made, rows.withColumnRenamed("published_at", "updated_at"), version=1, image_version=2)


@query(PAIRS + "select left_id, right_id from b where left_id in (select id from a where rooms = 2) and right_id in (select id from a where rooms = 2)")
def pairs_inside(spark, d):
    rows = approved(spark, d)
    return state.inside(catalogue.QUERIES["block_pairs"](spark, d), rows.where("rooms = 2"))


@query(L + ", s as (select 1 + event_id % 997 id, event_type from events) select id from a where id in (select id from s where event_type = 'click') or (id % 4 < 3 and id // 4 in (select id from s where event_type = 'purchase'))")
def favorites_any(spark, d):
    rows = approved(spark, d)
    marks = table(spark, d, "events").select((1 + F.col("event_id") % 997).alias("id"), "event_type")
    clusters = rows.where("id % 4 < 3").select("id", F.expr("id div 4").alias("cluster"))
    return state.marked(rows, clusters, marks.where("event_type = 'click'"), marks.where("event_type = 'purchase'").withColumnRenamed("id", "cluster")).select("id")


@query("with t as (select max(ts) as_of from events), m as (select user_id id, max(ts) filter (event_type = 'view') v, max(ts) filter (event_type = 'click') c from events group by 1) select id from m, t where v is null or v <= as_of - interval 30 hour or c is null or c <= as_of - interval 12 hour")
def due_for_any(spark, d):
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    as_of = events.agg(F.max("ts")).first()[0]
    people = events.select(F.col("user_id").alias("id")).distinct().withColumn("updated_at", F.lit("1970-01-01").cast("timestamp"))
    due = lambda kind, ttl: state.to_refresh(people, events.where(F.col("event_type") == kind).select(F.col("user_id").alias("id"), F.col("ts").alias("calculated_at"), history.expires(F.col("ts"), ttl).alias("valid_until")), as_of, limit=None)
    return state.any_of(due("view", 30 * 3600), due("click", 12 * 3600))


@query("select event_id, (t <= as_of) is_stale, case when t <= as_of and event_type <> 'error' then 'stale' when event_type = 'error' then 'failed' else 'ready' end effective_status, strftime(t, '%Y-%m-%dT%H:%M:%SZ') valid_until, greatest(epoch_us(as_of) - epoch_us(ts), 0) // 86400000000 age from (select event_id, event_type, ts, ts + interval 1 second * greatest(60, 3600 * (event_id % 3)) t, timestamp '2024-01-20 00:00:00' as_of from events)")
def assessment_status(spark, d):
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    as_of = F.lit("2024-01-20 00:00:00").cast("timestamp")
    until = F.when(F.col("event_id") % 3 == 0, history.expires(F.col("ts"), 0)).when(F.col("event_id") % 3 == 1, history.expires(F.col("ts"), 3600)).otherwise(history.expires(F.col("ts"), 7200))
    made = events.select("event_id", "ts", F.when(F.col("event_type") == "error", "failed").otherwise("ready").alias("status"), until.alias("valid_until"))
    return state.effective(made, as_of).select("event_id", "is_stale", "effective_status", history.iso(F.col("valid_until")).alias("valid_until"), F.floor(history.age_days(F.col("ts"), as_of)).alias("age"))


@query(SCORED + ", g as (select id // 4 card, min(price_uah) price_min, max(price_uah) price_max, max(score) score, max(published_at) published_at, min(id) id from m group by 1) select id, price_max, score from g order by price_max desc, id limit 60")
def cards_by_price(spark, d):
    rows = matching.matched(approved(spark, d), catalogue.PROFILE).groupBy(F.expr("id div 4").alias("card"))
    cards = rows.agg(F.min("price_uah").alias("price_min"), F.max("price_uah").alias("price_max"), F.max("score").alias("score"), F.max("published_at").alias("published_at"), F.min("id").alias("id"))
    return state.sorted_cards(cards, "price_desc").select("id", "price_max", "score").limit(60)


@query(L + " select id, lat, lon, case when total_area > 0 then (2 * price_uah + total_area) // (2 * total_area) end per_area, concat_ws(', ', case when pets_allowed then 'pets' end, case when children_allowed then 'children' end, case when backup_power then 'power' end) wishes from a where id % 4 > 0")
def checked_features(spark, d):
    rows = approved(spark, d)
    told = geo.features(rows, ["rooms"])
    broken = F.when(F.col("id") % 12 == 0, F.replace("feature", F.lit("Point"), F.lit("Line"))).when(F.col("id") % 12 == 4, F.lit("{")).when(F.col("id") % 12 == 8, F.replace("feature", F.lit('"coordinates":['), F.lit('"coordinates":[999,'))).otherwise(F.col("feature"))
    found = told.select("id", geo.read_point(broken).alias("at")).where("at is not null").select("id", "at.lat", "at.lon")
    flags = F.create_map(F.lit("pets"), F.col("pets_allowed"), F.lit("children"), F.col("children_allowed"), F.lit("power"), F.col("backup_power"))
    facts = rows.select("id", market.price_per_area(F.col("price_uah"), F.col("total_area"), 0).cast("bigint").alias("per_area"), F.array_join(state.enabled(flags, {"pets": "pets", "children": "children", "power": "power"}), ", ").alias("wishes"))
    return found.join(facts, "id")


@query(ASSESSED + """ select id, to_json({'id': id, 'title': title, 'price_uah': price_uah, 'rooms': rooms, 'location': {'city': city, 'district': district, 'street': street}, 'conditions': {'pets_allowed': pets_allowed, 'children_allowed': children_allowed, 'commission_percent': commission_percent, 'is_owner': is_owner}, 'market': {'status': ma.status, 'median': ma.median, 'confidence_label': ma.confidence_label}})::varchar context from a join ma on a.id = ma.target""")
def listing_context(spark, d):
    rows = approved(spark, d)
    found = catalogue.assessed(spark, d).select(F.col("target").alias("id"), "status", "median", "deviation", "confidence_label")
    none = found.select("id", F.lit(None).cast("int").alias("score"), F.lit(None).cast("string").alias("level"))
    c = lambda *names: F.struct(*[F.col(f"context.{n}") for n in names])
    told = F.struct(*[F.col(f"context.{n}") for n in ("id", "title", "price_uah", "rooms")], c("location.city", "location.district", "location.street").alias("location"), F.col("context.conditions"), c("market.status", "market.median", "market.confidence_label").alias("market"))
    return detail.context(rows, found, none).select("id", F.to_json(told, {"ignoreNullFields": "false"}).alias("context"))


@query("""with s as (select l_orderkey id, round(l_extendedprice)::bigint price, l_returnflag flag, l_linestatus title, l_shipdate "at" from lineitem),
  h as (select id, sha256('{"flag":"' || flag || '","price_uah":' || price || ',"title_hash":"' || sha256(trim(title)) || '"}') hash, min("at") "at", any_value(price) price from s group by id, flag, price, title),
  e as (select *, lag(price) over (partition by id order by "at", hash) was from h) select id, "at", was "old", price "new" from e where was is not null and was <> price""")
def captured_prices(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.round("l_extendedprice").cast("bigint").alias("price_uah"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("title"), F.col("l_shipdate").alias("captured_at"))
    return history.capture(rows, ["flag", "price_uah"], texts=("title",))[1].select("id", F.col("captured_at").alias("at"), "old", "new")


@query("select o_orderkey k, case when o_orderkey % 4 = 1 then 'again' when o_orderkey % 3 = 0 then 'second' else 'first' end v, o_custkey from orders where o_orderkey % 10 <> 7 and (o_orderkey % 2 = 0 or o_orderkey % 3 = 0 or o_orderkey % 4 = 1)")
def versioned_upsert(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit("first").alias("v"), "o_custkey")
    as_ = lambda on, v: rows.where(on).withColumn("v", F.lit(v))
    kept = VersionedTable(spark, f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}", rows.schema, ("k",))
    kept.apply("one", rows.where("k % 2 = 0"))
    kept.apply("two", as_("k % 3 = 0", "second"))
    kept.apply("one", as_("k % 2 = 0", "a replay, which changes nothing"))
    kept.compact()
    kept.apply("three", as_("k % 4 = 1", "again").where("k % 10 <> 7"), deleted=rows.where("k % 10 = 7"))
    return kept.read()


@query()
def incremental_clusters(spark, d):
    """Clusters after one in fifty listings has come anew and one in sixty has gone: those of a detection of all."""
    rows = approved(spark, d)
    before = incremental.detect(rows.where("id % 50 <> 1"), text=False)
    now = rows.where("id % 60 <> 2")
    return incremental.redetect(before, now, rows.where("id % 50 = 1 or id % 60 = 2"), text=False).clusters
