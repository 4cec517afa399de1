"""Rules by key: plain readings, batch against stream on rows out of order, and bounded state."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from dwellgraph.streaming.rules import Breaker, InOrder, Rate, Replay, decided, decided_stream

T0 = datetime.datetime(2024, 1, 1)
ROWS = "k string, ts timestamp, id bigint, flag bigint"


def made(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        at = T0 + datetime.timedelta(seconds=rng.randrange(3000), microseconds=rng.choice([0, 0, 17, 999_999]))
        rows.append((rng.choice("aaabcd"), at, i, rng.randrange(3) == 0))
    return rows


def plain(rows, rule):
    """Each rule told again, over all rows of a key in order."""
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3])
        history = []
        for _, at, i, flag in own:
            ago = lambda n: at - datetime.timedelta(seconds=n)  # noqa: E731, B023
            if isinstance(rule, Rate):
                good = sum(1 for t, a in history if a == "granted" and t > ago(rule.per_seconds)) < rule.limit
                answer = "granted" if good else "refused"
            else:
                opened = [t for t, a in history if a == "tripped"]
                run = []
                for t, a in reversed(history):
                    if a == "success" or (a != "refused" and (run[-1] if run else at) >= t + datetime.timedelta(seconds=rule.pause_seconds)):
                        break
                    run += [t] * (a != "refused")
                answer = "refused" if opened and opened[-1] > ago(rule.pause_seconds) else "success" if not flag else "tripped" if len(run) + 1 >= rule.limit else "failure"
            history.append((at, answer))
            out[i] = answer
    return out


RULES = [Breaker(limit=2, pause_seconds=40), Rate(limit=3, per_seconds=60), Rate(limit=1, per_seconds=1)]


@pytest.mark.parametrize("rule", RULES)
def test_batch_equals_plain(spark, rule):
    rows = made(1)
    frame = spark.createDataFrame([(*r[:3], int(r[3])) for r in rows] + [(None, T0, 900, 1), ("a", None, 901, 1)], ROWS)
    got = {r.tie: r.answer for r in decided(frame, rule, key="k", at="ts", tie="id", flag="flag").collect()}
    assert got == plain(rows, rule) and len(set(got.values())) >= 2


def test_replay_golden(spark):
    second = lambda n: T0 + datetime.timedelta(seconds=n)
    us = lambda t: int((t - datetime.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    rows = [("a", second(0), 1, us(second(-5))), ("a", second(299), 2, us(second(290))), ("a", second(300), 3, us(second(290))), ("b", second(10), 4, us(second(40))), ("b", second(11), 5, us(second(42))), ("c", second(4000), 6, us(second(399))), ("c", second(4001), 7, None), ("c", second(4002), 8, us(second(402)))]
    got = {r.tie: r.answer for r in decided(spark.createDataFrame(rows, ROWS), Replay(), key="k", at="ts", tie="id", flag="flag").collect()}
    assert got == {1: "accepted", 2: "replayed", 3: "accepted", 4: "accepted", 5: "future", 6: "expired", 7: "expired", 8: "accepted"}


@pytest.mark.parametrize("rule", [Breaker(limit=2, pause_seconds=40), Replay(ttl_seconds=200, max_age_seconds=10**10)])
def test_stream_equals_batch_out_of_order(spark, tmp_path, rule):
    """Rows come in files out of order, in several runs of the stream with one checkpoint."""
    rows = [(*r[:3], int(r[3])) for r in made(2)]
    want = {r.tie: r.answer for r in decided(spark.createDataFrame(rows, ROWS), rule, key="k", at="ts", tie="id", flag="flag").collect()}
    end = [("z", T0 + datetime.timedelta(days=9 + n), 10_000 + n, 1) for n in range(2)]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    parts = [rows[0::3], rows[1::3], rows[2::3], end[:1], end[1:]]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(source)
        if n in (1, 3, 4):
            stream = decided_stream(spark.readStream.schema(ROWS).parquet(source), rule, key="k", at="ts", tie="id", flag="flag", late="2 hours")
            stream.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    got = [(r.tie, r.answer) for r in spark.read.parquet(out).collect() if r.tie < 10_000]
    assert len(got) == len(want) and dict(got) == want
    if isinstance(rule, Breaker):
        left = spark.read.format("statestore").option("stateVarName", "waiting").load(state)
        assert left.count() <= 1  # only the last row waits
        kept = spark.read.format("statestore").option("stateVarName", "state").load(state).select(F.col("key.key").alias("key")).distinct()
        assert {r.key for r in kept.collect()} <= {"z"}


def test_state_of_a_rule_is_small():
    rate = Rate(limit=5, per_seconds=10)
    state = []
    for n in range(10_000):
        state, _ = rate.answer(state, n * 100_000, None)
        assert len(state) <= 5
    assert InOrder(rate).rule is rate
