"""Alignment of two tokenizers: bitsets of token ends, shared cuts by AND, token ranges by rank and select."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgraph.llm.common import fresh_name, materialize, prepare

#: A text may be encoded in pieces that are cut before such a space: no token of either vocabulary spans it.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Pieces of so many characters at most are kept with their ids, so many at once in a worker.
KEPT_LENGTH, KEPT_PIECES = 48, 300_000
#: Id pairs whose counts go to all tasks: at most so many, each a few numbers.
HOT_PAIRS = 1 << 19
ROWS_AT_ONCE = 64


def first_kind_bytes(token: str, _chars: dict[str, int] = {}) -> bytes:
    """The bytes of a byte-level token: printable bytes stand for themselves, the others for characters from 256 on, in order."""
    if not _chars:
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        _chars.update({chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)})
    return bytes(_chars[c] for c in token) if all(c in _chars for c in token) else token.encode()


def second_kind_bytes(piece: str) -> bytes:
    """The bytes of a sentence piece: <0xHH> is a byte, U+2581 a space."""
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Codec:
    """Both tokenizers of a pair: ids of a text, and the bytes of an id. Made from the files' contents, so that workers need no files."""

    def __init__(self, first: bytes, second: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(first.decode())
        self.first.encode_special_tokens = True
        self.second = SentencePieceProcessor(model_proto=second)
        vocabulary = self.first.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.bytes_a[i] = first_kind_bytes(token)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.bytes_b = [second_kind_bytes(p) for p in pieces]
        # Merges stay within a piece if no entry has a space behind anything but spaces.
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.sizes = tuple(np.array([len(b) for b in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.kept: dict[str, tuple[bytes, bytes]] = {}

    def _encode(self, pieces: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Of each text the ids of either tokenizer as 32-bit numbers; None if the tokens don't spell space and text."""
        out = []
        for text, a, b in zip(pieces, self.first.encode_batch_fast([f" {p}" for p in pieces], add_special_tokens=False), self.second.encode(pieces, num_threads=1), strict=True):
            spelled, ids = f" {text}".encode(), a.ids
            good = b"".join([self.bytes_a[i] for i in ids]) == spelled == b"".join([self.bytes_b[i] for i in b])
            out.append((np.array(ids, "<u4").tobytes(), np.array(b, "<u4").tobytes()) if good else None)
        return out

    def _encode_at_once(self, pieces: list[str]) -> list[tuple[bytes, bytes] | None]:
        """As _encode, of pieces without white space at their ends: as one text, whose ids are parted where the pieces end."""
        whole = self._encode([" ".join(pieces)])[0] if len(pieces) > 1 else None
        if whole is None:
            return self._encode(pieces)
        ends = np.cumsum([1 + len(p.encode()) for p in pieces])
        parts = []
        for raw, sizes in zip(whole, self.sizes, strict=True):
            at = np.searchsorted(np.cumsum(sizes[np.frombuffer(raw, "<u4")]), ends, "right") * 4
            parts.append([raw[i:j] for i, j in zip([0, *at[:-1].tolist()], at.tolist(), strict=True)])
        return list(zip(*parts, strict=True))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of both tokenizers for a text; None for an empty one and for one that either doesn't spell."""
        if not text:
            return None
        pieces = _CUT.split(text) if self.cuts else [text]
        # White space is at the ends of the first and the last piece only.
        ids = {p: self._encode([p])[0] for p in (pieces[0], pieces[-1]) if p != p.strip()}
        found = list(map(self.kept.get, pieces))
        if None in found:
            new = list({p for p, f in zip(pieces, found, strict=True) if f is None and p not in ids})
            ids.update(zip(new, self._encode_at_once(new), strict=True) if new else ())
            found = [ids[p] if f is None else f for p, f in zip(pieces, found, strict=True)]
            if len(self.kept) + len(ids) > KEPT_PIECES:
                self.kept.clear()
            self.kept.update((p, f) for p, f in ids.items() if f is not None and len(p) <= KEPT_LENGTH)
        if None in found:
            return None
        return tuple(np.frombuffer(b"".join(part), "<u4").astype(np.int64) for part in zip(*found, strict=True))


class Bits:
    """A packed bitset with a directory of ranks."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of_ends(cls, sizes: np.ndarray) -> Bits:
        """Marks the last byte of each token."""
        ends = np.cumsum(sizes)
        marks = np.zeros(-(-int(ends[-1]) // 64) * 64, np.uint8)
        marks[ends - 1] = 1
        return cls(np.packbits(marks, bitorder="little").view("<u8"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)

    def __len__(self) -> int:
        return int(self.before[-1])

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many marks are before each place."""
        word = places >> 6
        low = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def select(self) -> np.ndarray:
        """The places of all marks, in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


@dataclass(frozen=True)
class Aligned:
    """Token ranges of the groups (how many tokens of each side end up to a group's end), and the links as places of tokens."""

    ends_a: np.ndarray
    ends_b: np.ndarray
    links_a: np.ndarray
    links_b: np.ndarray


def align(sizes_a: np.ndarray, sizes_b: np.ndarray) -> Aligned:
    """Two tokenizations of the same bytes, by the bytes of their tokens.

    Where both have an end a group ends; the ranks there are the tokens of either side up to it. Between two
    neighbouring ends of either side there is one token of each, and two tokens that overlap do so in one such
    stretch: so each end of either side gives one link, of the tokens that the ranks name.
    """
    a, b = Bits.of_ends(sizes_a), Bits.of_ends(sizes_b)
    shared, either = (a & b).select(), (a | b).select()
    return Aligned(a.rank(shared) + 1, b.rank(shared) + 1, a.rank(either), b.rank(either))


class _Names(dict):
    """Ids with the character that follows them, as text; as many as both vocabularies have, twice."""

    def __missing__(self, number: int) -> str:
        self[number] = name = f"{number >> 7}{chr(number & 127)}"
        return name


_NAMES = _Names()


def group_text(ids_a: np.ndarray, ids_b: np.ndarray, found: Aligned) -> str:
    """Groups as `a1,a2|b1;a3|b2,b3`."""
    after_a, after_b = np.full(len(ids_a), 44), np.full(len(ids_b), 44)
    after_a[found.ends_a - 1], after_b[found.ends_b - 1] = 124, 59
    # A group's tokens of the first kind stand before those of the second, behind all of earlier groups.
    group_a, group_b = np.searchsorted(found.ends_a, np.arange(len(ids_a)), "right"), np.searchsorted(found.ends_b, np.arange(len(ids_b)), "right")
    place_a = np.arange(len(ids_a)) + np.concatenate([[0], found.ends_b])[group_a]
    place_b = np.arange(len(ids_b)) + found.ends_a[group_b]
    ids, after = np.empty(len(ids_a) + len(ids_b), np.int64), np.empty(len(ids_a) + len(ids_b), np.int64)
    ids[place_a], ids[place_b], after[place_a], after[place_b] = ids_a, ids_b, after_a, after_b
    return "".join(map(_NAMES.__getitem__, (ids << 7 | after).tolist()))[:-1]


_CODECS: dict[bytes, Codec] = {}


def _codec(first: bytes, second: bytes) -> Codec:
    """The codec of this worker, made once."""
    at = hashlib.sha256(first + second).digest()
    if at not in _CODECS:
        _CODECS.clear()
        _CODECS[at] = Codec(first, second)
    return _CODECS[at]


def public_pair() -> tuple[bytes, bytes]:
    """The contents of the two public tokenizers' files: byte-level BPE and sentence pieces."""
    import public_tokenizers

    out = []
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        with open(public_tokenizers.path(name), "rb") as f:
            out.append(f.read())
    return tuple(out)


def align_documents(docs: DataFrame, first: bytes, second: bytes, *, text: str = "text", key: str = "doc_id", with_groups: bool = False) -> DataFrame:
    """(row, key, n_a, n_b, n_groups, n_links, groups_sha256, pairs, counts) of each row, written to the shared folder.

    pairs are the row's different id pairs, as numbers (a times the second vocabulary's size, plus b), in
    order, counts how many links each has; with_groups adds the groups themselves. row tells rows apart
    that repeat a key. A null or empty text, one that isn't UTF-8, and one that either tokenizer doesn't spell have
    zeros, no pairs and an empty digest. A vocabulary's size is fixed by its file, so it goes out as a broadcast variable.
    """
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast((first, second))
    size_b = len(Codec(first, second).bytes_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*sent.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(lo, ROWS_AT_ONCE)
                numbers, digests, groups, pairs, counts = [], [], [], [], []
                for raw in part.column(2).to_pylist():
                    try:
                        ids = codec.encode((raw or b"").decode())
                    except UnicodeDecodeError:
                        ids = None
                    if ids is None:
                        numbers.append((0, 0, 0, 0))
                        digests.append("")
                        groups.append("")
                        pairs.append([])
                        counts.append([])
                        continue
                    found = align(codec.sizes[0][ids[0]], codec.sizes[1][ids[1]])
                    told = group_text(*ids, found)
                    numbers.append((len(ids[0]), len(ids[1]), len(found.ends_a), len(found.links_a)))
                    digests.append(hashlib.sha256(told.encode()).hexdigest())
                    groups.append(told if with_groups else "")
                    pair, n = np.unique(ids[0][found.links_a] * size_b + ids[1][found.links_b], return_counts=True)
                    pairs.append(pair)
                    counts.append(n.astype(np.int32))
                columns = [part.column(0), part.column(1), *(pa.array([x[k] for x in numbers], pa.int64()) for k in range(4)), pa.array(digests, pa.string()), pa.array(pairs, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))]
                names = ["row", key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "counts"]
                if with_groups:
                    columns.append(pa.array(groups, pa.string()))
                    names.append("groups")
                yield pa.RecordBatch.from_arrays(columns, names)

    row = fresh_name("row", docs.select(key))
    if row != "row":
        raise ValueError("the key can't be named row")
    kind = docs.schema[key].dataType.simpleString()
    schema = f"row bigint, `{key}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, counts array<int>" + ", groups string" * with_groups
    told = docs.select(F.monotonically_increasing_id().alias("row"), key, F.col(text).cast("binary")).mapInArrow(run, schema)
    return materialize(told, "aligned", codec="zstd")


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): how many links all rows have of each id pair, and whether no pair of its second id has more.

    Summed by task before the shuffle; the highest counts are one row for each id of the vocabulary.
    """
    each = aligned.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("x.pairs", "x.counts")
    pairs = materialize(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("n")), "pairs", codec="zstd")
    second = F.col("pair") % size_b
    top = pairs.groupBy(second.alias("b")).agg(F.max("n").alias("top"))
    return pairs.withColumn("b", second).join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def scored(aligned: DataFrame, counts: DataFrame, *, hot: int = HOT_PAIRS) -> DataFrame:
    """(row, n_best, count_sum) of each row that has links.

    Pairs with the highest counts, hot at most, go to all tasks; the rest, none of which is frequent, meets
    its counts in a shuffle. How frequent a pair has to be for that is told by a histogram of powers of two.
    """
    level = F.floor(F.log2("n")).cast("int")
    held, lowest = 0, 63
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
        if held + r["count"] > hot:
            break
        held, lowest = held + r["count"], r.level
    often = F.col("n") >= F.lit(1 << lowest).cast("bigint")
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("links"))
    sums = [F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum")]
    near = each.join(F.broadcast(counts.where(often)), "pair", "left")
    rare = counts.where(~often)
    if not lowest:
        return near.groupBy("row").agg(*sums)
    far = near.where("n is null").select("row", "pair", "links").join(rare, "pair").groupBy("row").agg(*sums)
    both = near.where("n is not null").groupBy("row").agg(*sums).union(far)
    return both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment_digests(docs: DataFrame, first: bytes, second: bytes, *, text: str = "text", key: str = "doc_id", hot: int = HOT_PAIRS) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of the table.

    n_best are the links whose id pair no other pair of its second id exceeds in the whole table, count_sum
    the sum of all links' counts. See align_documents for nulls, empty texts and repeated rows; an empty
    table gives no rows; other columns, of any name, are not looked at.
    """
    aligned = align_documents(docs, first, second, text=text, key=key)
    counts = materialize(pair_counts(aligned, len(Codec(first, second).bytes_b)), "pair-counts", codec="zstd")
    told = aligned.drop("pairs", "counts").join(scored(aligned, counts, hot=hot), "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return told.select(key, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
