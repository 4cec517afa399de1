"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgraph.llm.common import broadcast_if_small, fresh_name, materialize, mix, plain_words, prepare, word_hashes

#: Masks over consecutive tokens: positions with 1 are hashed, those with 0 may differ (fixed values).
MASKS = ("111011", "11010111", "1100110101", "1011000111")
#: Items too short for any mask are compared whole, by a mask of their own length without gaps.
SHORT = tuple("1" * n for n in range(1, min(map(len, MASKS))))
#: An overlap is a leak from so many equal tokens on (all of a shorter item), at this share of its span.
MIN_TOKENS = 13
IDENTITY = 0.8
#: Cost of a differing token against the gain of an equal one: stretches with IDENTITY sum to zero or more.
DIFFERS = round(IDENTITY / (1 - IDENTITY))
#: So many distinct benchmark hashes at most are sent to the tasks to sift the training hashes early.
SIFT_HASHES = 2_000_000
#: Bytes of item tokens that are sent to the tasks at most; beyond, they are joined.
ITEM_BYTES = 64 << 20

#: Texts are hashed together up to so many tokens; a longer one is hashed alone.
TOKENS_AT_ONCE = 1 << 15

#: Scripts that are written without spaces: each character is a token (code point ranges, fixed values).
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff"
_TOKEN = re.compile(rf"[{_UNSPACED}]|[^\W_{_UNSPACED}]+")


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased text's tokens: runs of letters and digits, and single characters of scripts without spaces."""
    if not text or text.isascii():
        return word_hashes(plain_words(text))
    return word_hashes([w.encode("utf-8", "surrogatepass") for w in _TOKEN.findall(text.lower())])


def spaced_hashes(words: np.ndarray, masks: tuple[str, ...] = MASKS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of every placement of every mask."""
    hashes, places = [], []
    for mask in masks:
        n = len(words) - len(mask) + 1
        if n <= 0:
            continue
        h = np.full(n, np.uint64(int(mask, 2)), np.uint64)
        for i, bit in enumerate(mask):
            if bit == "1":
                h = (h ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        hashes.append(mix(h))
        places.append(np.arange(n, dtype=np.int64))
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def together(texts: Iterator[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first, texts) of neighbouring texts' tokens, TOKENS_AT_ONCE or a single text at most."""
    first, part, size = 0, [], 0
    for words in texts:
        if part and size + len(words) > TOKENS_AT_ONCE:
            yield first, part
            first, part, size = first + len(part), [], 0
        part.append(words)
        size += len(words)
    if part:
        yield first, part


def hashes_of_texts(texts: list[np.ndarray], masks: tuple[str, ...], sift: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, position), in this order, of every placement of every mask within a text whose hash sift names by its index.

    The texts are hashed as one sequence, which costs less for short ones; placements across borders are left out.
    """
    words, ends = np.concatenate(texts), np.cumsum([len(t) for t in texts])
    found = []
    for mask in masks:
        h, at = spaced_hashes(words, (mask,))
        h = h.view(np.int64)
        near = sift(h)
        h, at = h[near], at[near]
        own = np.searchsorted(ends, at, "right")
        inside = at + len(mask) <= ends[own]
        own, h, at = own[inside], h[inside], at[inside]
        found.append((own, h, at - ends[own] + np.array([len(t) for t in texts])[own]))
    own, h, at = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((at, h, own))
    return own[order], h[order], at[order]


def best_overlap(text: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """(start in the text, end, equal tokens) of the stretch in which item[i] faces text[diagonal + i] with most equal tokens.

    Only stretches of which IDENTITY is equal count: those whose sum, with 1 for an equal token and -DIFFERS
    for another, is not negative. It begins and ends with equal tokens; of several the first is taken.
    """
    lo, hi = max(0, -diagonal), min(len(item), len(text) - diagonal)
    if hi <= lo:
        return 0, 0, 0
    same = item[lo:hi] == text[diagonal + lo : diagonal + hi]
    if not same.any():
        return 0, 0, 0
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -DIFFERS))])
    # From each start the farthest end whose sum is no smaller: the largest sum from there on falls from left to right.
    ahead = np.maximum.accumulate(total[::-1])[::-1]
    end = len(ahead) - np.searchsorted(ahead[::-1], total[:-1], side="left")
    equal = np.concatenate([[0], np.cumsum(same)])
    gain = equal[np.maximum(end - 1, np.arange(len(same)))] - equal[:-1]
    start = int(gain.argmax())
    at = np.flatnonzero(same[start : end[start] - 1]) + start
    return (diagonal + lo + int(at[0]), diagonal + lo + int(at[-1]) + 1, len(at)) if len(at) else (0, 0, 0)


def is_leak(item_tokens: int, start: int, end: int, equal: int) -> bool:
    return equal > 0 and equal >= min(MIN_TOKENS, IDENTITY * item_tokens) and equal >= IDENTITY * (end - start)


def leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "doc_id", item_text: str = "text", item: str = "item_id") -> DataFrame:
    """(key, item, start, end, equal): the longest confirmed overlap of each document with each benchmark item.

    Positions are in tokens of the document, end exclusive. Training and test hashes of all masks are
    joined; around each hit the two token sequences are laid side by side and the longest stretch with
    IDENTITY equal tokens is measured. It is a leak with MIN_TOKENS equal tokens, or IDENTITY of an item that
    is shorter. Items of fewer tokens than the shortest mask are found as they stand; so an item of one
    common word is found in most documents. Null and empty texts and null keys match nothing. Rows with the
    same key count as one document, items with the same id as one item. Without leaks, or with an empty
    table, there are no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    shortest = min(map(len, MASKS))

    def item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = tokens(batch.column(1)[i].as_py())
                h, at = spaced_hashes(words, MASKS if len(words) >= shortest else SHORT[len(words) - 1 : len(words)])
                n = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([batch.column(0)[i].as_py()] * n, batch.schema.field(0).type), pa.array(at), pa.array([min(len(words), shortest)] * n, pa.int32())], ["h", "item", "at", "size"])

    def item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [tokens(x.as_py()).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["item", "item_tokens"])

    items = benchmark.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), F.col(item_text).alias("item_text"))
    made = materialize(items.mapInArrow(item_rows, f"h bigint, item {item_kind}, at bigint, size int").distinct(), "test")
    # One row for a hash in an item, however often it stands there.
    test = materialize(made.groupBy("h", "item").agg(F.array_sort(F.collect_set("at")).alias("ats")), "test")
    # Only for lengths of short items are hashes without gaps made: those lengths are fewer than the shortest mask.
    masks = MASKS + tuple("1" * r["size"] for r in made.where(F.col("size") < shortest).select("size").distinct().orderBy("size").collect())
    distinct = test.select("h").distinct()
    sift = None
    if distinct.count() <= SIFT_HASHES:
        sift = spark.sparkContext.broadcast(np.sort(distinct.toArrow().column(0).to_numpy().astype(np.int64)))

    def training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if sift is None else sift.value
        if known is not None:
            flags = np.zeros(1 << 22, bool)
            flags[known & (len(flags) - 1)] = True

        def sifted(h: np.ndarray) -> np.ndarray:
            if known is None:
                return np.arange(len(h))
            near = np.flatnonzero(flags[h & (len(flags) - 1)])
            return near[known[np.minimum(np.searchsorted(known, h[near]), len(known) - 1)] == h[near]] if len(near) else near

        for batch in batches:
            keys = batch.column(0)
            for low, part in together(tokens(x.as_py()) for x in batch.column(1)):
                own, h, at = hashes_of_texts(part, masks, sifted)
                if len(h):  # one row for a hash in a text, with all its places
                    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])]))
                    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(h)).astype(np.int32)), pa.array(at))
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(low + own[first])), pa.array(h[first]), places], ["doc", "h", "places"])

    def diagonals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                places, ats = (np.asarray(batch.column(c)[i].values) for c in (2, 3))
                low = places[0] - ats[-1]
                seen = np.zeros(places[-1] - ats[0] - low + 1, bool)
                for at in ats:
                    seen[places - at - low] = True
                found = np.flatnonzero(seen) + low
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(c)[i].as_py()] * len(found), batch.schema.field(c).type) for c in (0, 1)] + [pa.array(found)], ["doc", "item", "diagonal"])

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("own_text"))
    hits = rows.mapInArrow(training, f"doc {kind}, h bigint, places array<bigint>")
    met = hits.join(broadcast_if_small(test), "h").select("doc", "item", "places", "ats").mapInArrow(diagonals, f"doc {kind}, item {item_kind}, diagonal bigint").distinct()
    met = materialize(met, "met")
    texts = materialize(items.mapInArrow(item_tokens, f"item {item_kind}, item_tokens binary").distinct(), "items")
    # The text of a document is sent once, to where its items and their diagonals are.
    by_item = met.groupBy("doc", "item").agg(F.collect_list("diagonal").alias("diagonals")).join(broadcast_if_small(texts, size=ITEM_BYTES), "item")
    by_doc = by_item.groupBy("doc").agg(F.collect_list(F.struct("item", "item_tokens", "diagonals")).alias("against"))
    wanted = materialize(met.select("doc").distinct(), "wanted")
    told = materialize(rows.join(broadcast_if_small(wanted), "doc", "left_semi"), "told")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                words, doc = tokens(batch.column(1)[i].as_py()), batch.column(0)[i].as_py()
                against = batch.column(2)[i].values
                for k in range(len(against)):
                    test_words = np.frombuffer(against.field("item_tokens")[k].as_py(), np.uint64)
                    for diagonal in np.asarray(against.field("diagonals")[k].values):
                        start, end, equal = best_overlap(words, test_words, int(diagonal))
                        if is_leak(len(test_words), start, end, equal):
                            out.append((doc, against.field("item")[k].as_py(), start, end, equal))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = [batch.schema.field(0).type, batch.schema.field(2).type.value_type.field("item").type, pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc", "item", "start", "end", "equal"])

    laid = told.join(by_doc, "doc").select("doc", "own_text", "against")
    found = laid.mapInArrow(verify, f"doc {kind}, item {item_kind}, start bigint, end bigint, equal bigint")
    best = found.groupBy("doc", "item").agg(F.max(F.struct("equal", (-F.col("start")).alias("s"), F.col("end"))).alias("best"))
    return best.select(F.col("doc").alias(key), F.col("item").alias(item), (-F.col("best.s")).alias("start"), F.col("best.end").alias("end"), F.col("best.equal").alias("equal"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "doc_id", **names: str) -> DataFrame:
    """The documents without a leak, all their columns unchanged; a row with a null key stays."""
    name = fresh_name("leaking", docs)
    found = materialize(leaks(docs, benchmark, text=text, key=key, **names).select(F.col(key).alias(name)).distinct(), "leaking")
    return docs.join(broadcast_if_small(found), F.col(key) == F.col(name), "left_anti")
