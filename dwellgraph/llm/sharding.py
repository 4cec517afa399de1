"""Shards of nearly equal bytes: the smallest capacity that contiguous runs of groups need, found by binary search."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgraph.llm.common import fresh_name, materialize

#: Shards of the query.
SHARDS = 16
#: A group's place in the order is its 64-bit hash. The first look at the order has 2^FIRST cells, a closer one 2^STEP in each cell.
FIRST, STEP = 12, 8


class Unresolved(Exception):
    """A place lies within cells that hold several groups."""

    def __init__(self, cells: set[int]):
        super().__init__(cells)
        self.cells = cells


@dataclass(frozen=True)
class Cell:
    """Neighbouring groups of the order: those whose hash begins with the same bits."""

    low: int
    high: int
    size: int
    bits: int

    @property
    def single(self) -> bool:
        return self.low == self.high


class Cells:
    """What is known of the order: cells, of which some are single groups, and the bytes before each."""

    def __init__(self, cells: list[Cell]):
        self.cells = sorted(cells, key=lambda c: c.low)
        self.edges = [0]
        for c in self.cells:
            self.edges.append(self.edges[-1] + c.size)
        self.total = self.edges[-1]

    def within(self, x: int) -> int | None:
        """The cell that x lies strictly inside of, if it is no edge."""
        i = bisect_right(self.edges, x) - 1
        return None if self.edges[i] == x else i

    def below(self, x: int) -> int:
        """The last edge of a group at or before x."""
        if x >= self.total:
            return self.total
        i = self.within(x)
        if i is None:
            return x
        if not self.cells[i].single:
            raise Unresolved({i})
        return self.edges[i]

    def above(self, x: int) -> int:
        """The first edge of a group at or after x."""
        if x <= 0:
            return 0
        i = self.within(x)
        if i is None:
            return x
        if not self.cells[i].single:
            raise Unresolved({i})
        return self.edges[i + 1]

    def filled(self, capacity: int, shards: int, hopeful: bool) -> list[int] | None:
        """The edges of shards filled one after the other up to the capacity; None if groups are left over.

        A cell of several groups may be cut anywhere if hopeful, and nowhere if not.
        """
        at, out = 0, []
        for _ in range(shards):
            x = at + capacity
            if x >= self.total:
                at = self.total
            else:
                i = self.within(x)
                at = x if i is None or (hopeful and not self.cells[i].single) else self.edges[i]
            out.append(at)
        return out if at == self.total else None

    def least(self, shards: int, hopeful: bool) -> int:
        """The smallest capacity that filled() accepts, by binary search."""
        low, high = -(-self.total // shards), self.total
        while low < high:
            middle = (low + high) // 2
            if self.filled(middle, shards, hopeful) is None:
                low = middle + 1
            else:
                high = middle
        return low

    def capacity(self, shards: int) -> int:
        """The smallest capacity; Unresolved with the cells that have to be known for it."""
        hopeful, safe = self.least(shards, True), self.least(shards, False)
        if hopeful == safe:
            return safe
        # A shard's end at any capacity between the two lies between these two ends.
        early, late = self.filled(hopeful, shards, False), self.filled(safe, shards, True)
        early = early or self._ends(hopeful, shards)
        unknown = set()
        for a, b in zip(early, late, strict=True):
            first, last = bisect_right(self.edges, a) - 1, bisect_left(self.edges, b)
            unknown |= {i for i in range(max(0, first), min(last, len(self.cells))) if not self.cells[i].single}
        raise Unresolved(unknown)

    def _ends(self, capacity: int, shards: int) -> list[int]:
        at, out = 0, []
        for _ in range(shards):
            x = at + capacity
            at = self.total if x >= self.total else self.edges[bisect_right(self.edges, x) - 1]
            out.append(at)
        return out

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """The ends of all shards but the last: none exceeds the capacity, each is as near to the mean of what is left as that lets it."""
        least = [self.total]
        for _ in range(shards - 1):
            least.append(self.above(least[-1] - capacity))
        least.reverse()  # of shard k, the first end from which the capacity still suffices
        at, out = 0, []
        for k in range(shards - 1):
            wish = at + round((self.total - at) / (shards - k))
            before, after = self.below(wish), self.above(wish)
            near = before if wish - before <= after - wish else after
            at = min(max(near, least[k]), self.below(at + capacity))
            out.append(at)
        return out

    def last_key(self, edge: int) -> int | None:
        """The hash of the last group before an edge; None at the beginning."""
        i = bisect_left(self.edges, edge)
        return self.cells[i - 1].high if i else None


@dataclass(frozen=True)
class Plan:
    """Which shard a group belongs to: alone, by its hash, or by the last hashes of the shards before it."""

    shards: int
    alone: tuple[int, ...]
    last_keys: tuple[int | None, ...]
    capacity: int

    def shard(self, group: Column) -> Column:
        first = len(self.alone)
        after = [F.lit(1) if k is None else (group > F.lit(k)).cast("int") for k in self.last_keys]
        place = reduce(lambda a, b: a + b, after, F.lit(first))
        for k, key in enumerate(self.alone):
            place = F.when(group == F.lit(key), k).otherwise(place)
        return place.cast("int")


def group_of(text: Column) -> Column:
    """A text's place in the order: equal texts have one place, a null text that of an empty one.

    Different texts of one hash are one group, which costs nothing but evenness.
    """
    return F.xxhash64(F.coalesce(text, F.lit("")))


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def plan(sizes: DataFrame, shards: int = SHARDS, *, group: str = "group", size: str = "size") -> Plan:
    """The shards of a table of (group, size): contiguous runs of groups in the order of their hashes, the largest as small as can be.

    A group above the mean of what is left can't share a shard without making it the largest, so it gets one
    of its own, the largest first; at most shards - 1 groups are such. For the rest the smallest feasible
    capacity is searched on the driver, over sums of cells of the order: 2^FIRST to begin with, then
    2^STEP of each cell in which a shard could end, until single groups are told apart. So the driver holds
    a number of sums that depends on the number of shards, not of groups. An empty table has empty shards.
    """
    by_group = sizes.groupBy(F.col(group).alias("g")).agg(F.sum(size).alias("s"))
    total = sizes.agg(F.sum(size).alias("s")).first().s or 0
    alone: list[int] = []
    for r in by_group.orderBy(F.desc("s"), "g").limit(shards - 1).collect():
        if r.s * (shards - len(alone)) <= total:
            break
        alone.append(r.g)
        total -= r.s
    rest = sizes.where(~F.col(group).isin(alone)) if alone else sizes
    left = shards - len(alone)

    def look(rows: DataFrame, bits: int) -> list[Cell]:
        cell = F.shiftright(F.col(group), 64 - bits)
        found = rows.groupBy(cell.alias("c")).agg(F.min(group).alias("low"), F.max(group).alias("high"), F.sum(size).alias("s"))
        return [Cell(r.low, r.high, r.s, bits) for r in found.collect()]

    known = Cells(look(rest, FIRST))
    while True:
        try:
            capacity = known.capacity(left)
            keys = tuple(known.last_key(c) for c in known.cuts(capacity, left))
            return Plan(shards, tuple(alone), keys, capacity)
        except Unresolved as e:
            closer, wanted = [], [known.cells[i] for i in e.cells]
            for bits in {c.bits for c in wanted}:
                prefixes = [c.low >> (64 - bits) for c in wanted if c.bits == bits]
                closer += look(rest.where(F.shiftright(F.col(group), 64 - bits).isin(prefixes)), min(64, bits + STEP))
            known = Cells([c for i, c in enumerate(known.cells) if i not in e.cells] + closer)


def assign(docs: DataFrame, shards: int = SHARDS, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of each row: shards of nearly equal bytes, equal texts in one.

    The law is `bytes`: sizes are the text's UTF-8 bytes plus 1, equal texts are one group, and the largest shard
    is as small as contiguous groups in the order of their hashes allow. Slots count from 0 in each shard,
    by the group's hash, then by key (nulls first); rows that repeat a key and a text get slots of their own, in
    any order. A null text counts as an empty one: size 1, checksum 0. grown_shard is null: it belongs to
    another law. An empty table gives no rows; other columns, of any name, are not looked at.
    """
    text_of = F.col(text)
    narrow = docs.select(F.col(key).alias("key"), size_of(text_of).alias("size"), F.crc32(F.coalesce(text_of, F.lit("")).cast("binary")).alias("crc"), group_of(text_of).alias("group"))
    narrow = materialize(narrow, "shard-rows")
    found = plan(narrow.select("group", "size"), shards)
    # A range of (shard, group, key) is split wherever rows are many, within a group of copies too.
    dealt = narrow.withColumn("shard", found.shard(F.col("group"))).repartitionByRange("shard", "group", "key").sortWithinPartitions("shard", "group", "key")
    dealt = materialize(dealt.select("key", "size", "crc", "shard", F.monotonically_increasing_id().alias("at")), "shard-slots")
    # Of each partition, the rows of each shard it holds: a row for each partition, and one more for each shard.
    part = F.shiftright("at", 33)
    runs = dealt.groupBy(part.alias("part"), "shard").agg(F.min("at").alias("first"), F.count("*").alias("n")).collect()
    offset, before = [], dict.fromkeys(range(shards), 0)
    for r in sorted(runs, key=lambda r: (r.shard, r.part)):
        offset.append((r.part, r.shard, before[r.shard] - r.first))
        before[r.shard] += r.n
    offsets = docs.sparkSession.createDataFrame(offset, "part bigint, shard int, shift bigint")
    told = dealt.withColumn("part", part).join(F.broadcast(offsets), ["part", "shard"])
    return told.select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, *, text: str = "text") -> DataFrame:
    """Write the rows into a folder for each shard, with all their columns, and return the table as read back.

    The shard stands in a column `shard`, with underscores appended if the table has one of that name. A
    shard's rows are dealt over tasks by size, so a shard with a large group is several files.
    """
    found = plan(docs.select(group_of(F.col(text)).alias("group"), size_of(F.col(text)).alias("size")), shards)
    name = fresh_name("shard", docs)
    dealt = docs.withColumn(name, found.shard(group_of(F.col(text))))
    dealt.hint("rebalance", F.col(name)).write.partitionBy(name).parquet(path)
    return docs.sparkSession.read.schema(dealt.schema).parquet(path)
