"""Rules that decide rows one after the other by key: replay protection, breakers and rate limits, as streams and as batches.

A rule keeps a small state for each key and answers each row in the order of time. As a stream it is a stateful
processor: rows wait in state until the watermark has passed them, so that late ones take their place; as a
batch the rows are sorted by key and time and read through, so that even a key with most of the rows takes
constant memory. Both give the same answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from dwellgraph.operators.lineage import importable

_SECOND = 1_000_000


@dataclass(frozen=True)
class Replay:
    """A message counts once in ttl_seconds, and only if it was sent at most max_age_seconds before and not over ahead_seconds after it comes.

    Rows have a flag, the microseconds at which the message was sent. Answers: accepted, replayed, expired, future.
    """

    ttl_seconds: float = 300
    max_age_seconds: float = 3600
    ahead_seconds: float = 30

    def answer(self, state: list[int], at: int, flag: int | None) -> tuple[list[int], str]:
        age = None if flag is None else at - flag
        if age is None or age > self.max_age_seconds * _SECOND:
            return state, "expired"
        if age < -self.ahead_seconds * _SECOND:
            return state, "future"
        if state and at < state[0]:
            return state, "replayed"
        return [at + int(self.ttl_seconds * _SECOND)], "accepted"

    def ends(self, state: list[int]) -> int:
        return state[0]


@dataclass(frozen=True)
class Breaker:
    """After limit failures in a row, none over pause_seconds after the one before, calls are refused for pause_seconds.

    Rows have a flag: 1 for a failed call. Answers: success, failure, tripped (the failure that opens it), refused.
    A refused call isn't made and changes nothing. A success forgets the failures.
    """

    limit: int = 3
    pause_seconds: float = 60

    def answer(self, state: list[int], at: int, flag: int | None) -> tuple[list[int], str]:
        failures, until, opened = state or [0, 0, 0]
        if at < opened:
            return state, "refused"
        if not flag:
            return [], "success"
        failures, until = (failures if at < until else 0) + 1, at + int(self.pause_seconds * _SECOND)
        if failures >= self.limit:
            return [failures, until, until], "tripped"
        return [failures, until, 0], "failure"

    def ends(self, state: list[int]) -> int:
        return max(state[1:])


@dataclass(frozen=True)
class Rate:
    """At most limit rows are granted within any per_seconds; what is refused doesn't count. Answers: granted, refused."""

    limit: int = 12
    per_seconds: float = 3600

    def answer(self, state: list[int], at: int, flag: int | None) -> tuple[list[int], str]:
        recent = [t for t in state if t > at - self.per_seconds * _SECOND]
        return (recent, "refused") if len(recent) >= self.limit else ([*recent, at], "granted")

    def ends(self, state: list[int]) -> int:
        return state[-1] + int(self.per_seconds * _SECOND)


Rule = Replay | Breaker | Rate


def _prepared(rows: DataFrame, key: str, at: str, tie: str, flag: str | None) -> DataFrame:
    importable(rows.sparkSession)
    return rows.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(tie).cast("bigint").alias("tie"), (F.col(flag).cast("bigint") if flag else F.lit(None).cast("bigint")).alias("flag"))


def decided(rows: DataFrame, rule: Rule, *, key: str, at: str, tie: str, flag: str | None = None) -> DataFrame:
    """(key, at, tie, answer) of each row with a key and a time; of equal times the smaller tie comes first."""
    known = _prepared(rows, key, at, tie, flag).where("key is not null and at is not null").withColumn("us", F.unix_micros("at"))
    asked = known.repartition("key").sortWithinPartitions("key", "us", "tie")

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        last, state = None, []
        for batch in batches:
            answers = []
            for k, us, f in zip(batch["key"].to_pylist(), batch["us"].to_pylist(), batch["flag"].to_pylist(), strict=True):
                if k != last:
                    last, state = k, []
                state, answer = rule.answer(state, us, f)
                answers.append(answer)
            yield pa.RecordBatch.from_arrays([batch["key"], batch["at"], batch["tie"], pa.array(answers, pa.string())], ["key", "at", "tie", "answer"])

    return asked.mapInArrow(run, "key string, at timestamp, tie bigint, answer string")


class InOrder(StatefulProcessor):
    """Answers the rows of a key in the order of their times, once the watermark has passed them.

    Waiting rows are a list, the rule's state a list of numbers. Each waiting time has a timer; the state has one
    for its end, at which it is cleared, so a key that is quiet for so long has no state.
    """

    def __init__(self, rule: Rule):
        self.rule = rule

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, tie bigint, flag bigint")
        self.state = handle.getListState("state", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Any]:
        new = []
        for part in rows:
            micros = part["at"].astype("int64") // {"ns": 1000, "us": 1}[getattr(part["at"].dtype, "unit", "ns")]
            new += zip(micros.tolist(), part["tie"].tolist(), [None if f != f or f is None else int(f) for f in part["flag"]], strict=True)
        self.waiting.appendList([tuple(r) for r in new])
        # A timer is due when the watermark is over it: a millisecond is up when the next begins.
        for due in {us // 1000 + 1 for us, *_ in new}:
            self.handle.registerTimer(due)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Any]:
        import pandas as pd

        due = expiredTimerInfo.getExpiryTimeInMs()
        waiting = sorted((r[0], r[1], r[2]) for r in self.waiting.get()) if self.waiting.exists() else []
        state = [r[0] for r in self.state.get()] if self.state.exists() else []
        out = []
        for us, tie, flag in waiting:
            if us // 1000 >= due:
                break
            state, answer = self.rule.answer(state, us, flag)
            out.append((key[0], us, tie, answer))
        if out:
            rest = waiting[len(out) :]
            self.waiting.put(rest) if rest else self.waiting.clear()
            if state:
                self.state.put([(n,) for n in state])
                self.handle.registerTimer(self.rule.ends(state) // 1000 + 1)
            else:
                self.state.clear()
            told = pd.DataFrame(out, columns=["key", "at", "tie", "answer"])
            told["at"] = pd.to_datetime(told["at"], unit="us")
            yield told
        elif state and self.rule.ends(state) // 1000 < due and not waiting:
            self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


#: Streams with timers keep their state in this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def decided_stream(stream: DataFrame, rule: Rule, *, key: str, at: str, tie: str, flag: str | None = None, late: str = "1 hour") -> DataFrame:
    """As decided(), of a stream: an answer comes when the watermark (late behind the newest row) has passed the row.

    Rows that come later than that are dropped, as everywhere with a watermark. Sets the session's state store to STORE.
    """
    for name, value in STORE.items():
        stream.sparkSession.conf.set(name, value)
    known = _prepared(stream, key, at, tie, flag).where("key is not null and at is not null").withWatermark("at", late)
    return known.groupBy("key").transformWithStateInPandas(InOrder(rule), "key string, at timestamp, tie bigint, answer string", "Append", "EventTime")
