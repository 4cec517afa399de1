"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

Encoding reads bytes left to right. Every prefix of a text has one last token: the one that ends there and
may follow the last token of the prefix before it. A configuration of the machine holds the positions from
which some vocabulary entry can still reach beyond the current byte: for each, the trie node read since
then and the last token before it. Equal configurations are one state; states and arcs are made when first
met and kept. An arc tells the last token of the prefix it completes; tokens are emitted once all positions
that are still open agree on them, so output lags by a bounded number of bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dwellgraph.llm.common import held, prepare

#: White space as the tokenizer's pattern means it (fixed values).
WHITE = r"\t-\r \x85\xa0  -     　"
#: A text's runs between which every match of the pattern begins anew.
CHUNK = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

NEVER = 1 << 60
#: A node with so many tokens below it at most counts as having few.
FEW = 16
STATE_LIMIT = 300_000
CHUNK_LIMIT = 300_000
ROWS_AT_ONCE = 256


def load_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merge_by_rank(ranks: dict[bytes, int], piece: bytes, stop: int = NEVER) -> list[int]:
    """Plain BPE: merge the lowest-ranked adjacent pair, leftmost first, until none is left below stop."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], NEVER), i))
        if ranks.get(parts[best] + parts[best + 1], NEVER) >= stop:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """The machine of one vocabulary; one per Python worker."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        # The two parts whose merge makes a token, by its id; single bytes have none.
        self.parts: dict[int, tuple[int, int]] = {}
        # The trie of what merges can make: child[node << 8 | byte] -> node; accept[node] -> token id.
        self.child: dict[int, int] = {}
        self.accept: dict[int, int] = {}
        self.nodes = 1
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                made = merge_by_rank(ranks, token, stop=rank)
                if len(made) != 2:  # no merges reach it, so it is never emitted within a piece
                    continue
                self.parts[rank] = (made[0], made[1])
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = self.nodes
                    self.nodes += 1
                node = self.child[key]
            self.accept[node] = rank
        # Tokens strictly below a node, where they are few.
        below: list[list[int] | None] = [[] for _ in range(self.nodes)]
        for key, to in sorted(self.child.items(), key=lambda x: -x[1]):  # children have higher numbers
            up, own = below[key >> 8], below[to]
            own = None if own is None else own + ([self.accept[to]] if to in self.accept else [])
            if up is not None:
                below[key >> 8] = None if own is None or len(up) + len(own) > FEW else up + own
        self.below = below
        self.size = {i: len(t) for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.follows: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.configs: list[tuple] = []
        self.arcs: list[dict[int, tuple[int, int]]] = []
        self.kinds: dict[frozenset, int] = {}
        self.allowed: list[frozenset] = []
        self.opened: dict[tuple[int, int], tuple[int, int] | None] = {}
        self.start = self.state(((0, -1),))

    def renew(self, at: int) -> int:
        """Forget all states but one, which may lie within a piece; its number from now on."""
        config, allowed = self.configs[at], self.allowed
        self.reset()
        kept = []
        for node, last in config:
            if last < -1:
                may = allowed[-2 - last]
                kind = self.kinds.setdefault(may, len(self.kinds))
                if kind == len(self.allowed):
                    self.allowed.append(may)
                last = -2 - kind
            kept.append((node, last))
        return self.state(tuple(kept))

    def state(self, config: tuple) -> int:
        if config not in self.ids:
            self.ids[config] = len(self.configs)
            self.configs.append(config)
            self.arcs.append({})
        return self.ids[config]

    def spine(self, token: int, side: int) -> list[int]:
        """The token and its outermost parts on one side, largest first."""
        out = [token]
        while out[-1] in self.parts:
            out.append(self.parts[out[-1]][side])
        return out

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both leaves the two tokens as they are.

        Merges happen by rank, so at each moment the parts next to the border are those made so far;
        the border holds if no pair of such parts has a merge due before the next of them grows. Of
        equal ranks the left one comes first.
        """
        if left < 0:
            return True
        key = left << 32 | right
        if key not in self.follows:
            if len(self.follows) > 500_000:
                self.follows.clear()
            a, b = self.spine(left, 1), self.spine(right, 0)
            i, j, holds = len(a) - 1, len(b) - 1, True
            while holds:
                grow_a, grow_b = a[i - 1] if i else NEVER, b[j - 1] if j else NEVER
                due = self.ranks.get(self.tokens[a[i]] + self.tokens[b[j]], NEVER)
                # A merge to the left of the border goes first at its own rank, one to the right after it.
                if due < NEVER and due < grow_a and due <= grow_b:
                    holds = False
                elif grow_a == NEVER and grow_b == NEVER:
                    break
                elif grow_a <= grow_b:
                    i -= 1
                else:
                    j -= 1
            self.follows[key] = holds
        return self.follows[key]

    def open(self, node: int, last: int) -> tuple[int, int] | None:
        """An open position as a state keeps it; None if no token can end further on.

        Where few tokens are left below a node, it matters only which of them may follow, not after
        which token: the number of that set, as a negative one, stands for the last token.
        """
        key = (node, last)
        if key not in self.opened:
            few = self.below[node]
            if few is None:
                self.opened[key] = key
            else:
                may = frozenset(t for t in few if self.fits(last, t))
                kind = self.kinds.setdefault(may, len(self.kinds))
                if kind == len(self.allowed):
                    self.allowed.append(may)
                self.opened[key] = (node, -2 - kind) if may else None
        return self.opened[key]

    def fits(self, last: int, token: int) -> bool:
        return token in self.allowed[-2 - last] if last < -1 else self.may_follow(last, token)

    def arc(self, at: int, byte: int) -> tuple[int, int]:
        """Determinise one arc: the last token of the prefix it completes, and the state it leads to."""
        nxt, here = [], -1
        for node, last in self.configs[at]:
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            entry = self.open(to, last)
            if entry:
                nxt.append(entry)
            token = self.accept.get(to)
            if here < 0 and token is not None and self.fits(last, token):
                here = token
        nxt.append((0, here))
        self.arcs[at][byte] = found = (here, self.state(tuple(nxt)))
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        ends: list[int] = []  # the last token of each prefix since the last emitted token
        at, arcs, depth = self.start, self.arcs, self.longest
        for byte in piece:
            got = arcs[at].get(byte)
            if got is None:
                if len(self.configs) > STATE_LIMIT:
                    at = self.renew(at)
                    arcs = self.arcs
                got = self.arc(at, byte)
            token, at = got
            ends.append(token)
            if len(ends) >= 4 * depth:
                self.emit(ends, depth, out)
        size, i, tail = self.size, len(ends), []
        while i:
            tail.append(ends[i - 1])
            i -= size[ends[i - 1]]
        return out + tail[::-1]

    def emit(self, ends: list[int], depth: int, out: list[int]) -> None:
        """Move the tokens that the positions of the last depth bytes share from ends to out."""
        paths = []
        for at in range(len(ends) - depth, len(ends) + 1):
            path, size = [], at
            while size > 0:
                path.append(ends[size - 1])
                size -= self.size[ends[size - 1]]
            paths.append(path[::-1])
        least = min(map(len, paths))
        shared = next((i for i in range(least) if any(p[i] != paths[0][i] for p in paths)), least)
        out += paths[0][:shared]
        del ends[: sum(self.size[t] for t in paths[0][:shared])]


class Encoder(dict):
    """Chunk of text -> its ids as little-endian uint32 bytes, kept for the chunks met so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = CHUNK_LIMIT):
        import regex

        super().__init__()
        self.limit = limit
        self.machine = Transducer(ranks)
        self.split = regex.compile(pattern.replace(r"\S", f"[^{WHITE}]").replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]"))

    def __missing__(self, chunk: str) -> bytes:
        ids: list[int] = []
        for m in self.split.findall(chunk):
            ids += self.machine.encode_piece(m.encode("utf-8"))
        value = np.asarray(ids, "<u4").tobytes()
        if len(chunk) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = value
        return value

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, CHUNK.findall(text)))


def _utf8_machine() -> list[list[int]]:
    """States: 0 between characters; 1..3 bytes of any value left; 4..7 first byte after E0, ED, F0, F4; 8 refusal."""
    t = [[8] * 256 for _ in range(9)]
    for b in range(256):
        if b < 0x80:
            t[0][b] = 0
        elif 0xC2 <= b <= 0xDF:
            t[0][b] = 1
        elif 0xE0 <= b <= 0xEF:
            t[0][b] = {0xE0: 4, 0xED: 5}.get(b, 2)
        elif 0xF0 <= b <= 0xF4:
            t[0][b] = {0xF0: 6, 0xF4: 7}.get(b, 3)
        if 0x80 <= b <= 0xBF:
            t[1][b], t[2][b], t[3][b] = 0, 1, 2
            if b >= 0xA0:
                t[4][b] = 1
            else:
                t[5][b] = 1
            if b >= 0x90:
                t[6][b] = 2
            else:
                t[7][b] = 2
    return t


UTF8 = _utf8_machine()


class StreamDecoder:
    """Ids in, text out: bytes of a character that is not complete wait for the next call.

    The machine says where the last complete character ends; what lies before that is decoded in one go by
    Python's decoder. Between calls only its state and at most three bytes are kept. Bytes that cannot begin or
    go on with a character come out as U+FFFD, as Python's decoder with errors="replace" puts them.
    """

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens, self.rest, self.state = tokens, b"", 0

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        data = self.rest + b"".join(map(self.tokens.__getitem__, ids))
        cut = len(data)
        if not final:  # walk the machine over the last bytes only: a character has four at most
            i = cut - 1
            while i >= 0 and i > cut - 4 and 0x80 <= data[i] <= 0xBF:
                i -= 1
            if i >= 0:
                state = 0
                for byte in data[i:]:
                    state = UTF8[state][byte]
                self.state = state
                if 0 < state < 8:
                    cut = i
        self.rest = data[cut:]
        return data[:cut].decode("utf-8", "replace")


def encoder_of(ranks: dict[bytes, int], pattern: str, limit: int = CHUNK_LIMIT) -> Encoder:
    """The worker's encoder for a vocabulary: tasks that follow on the same worker go on with its states."""
    key = (len(ranks), hash(frozenset(ranks.items())), pattern, limit)
    return held(key, lambda: Encoder(ranks, pattern, limit))


def _ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return load_ranks(f)


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, text: str = "text", key: str = "doc_id", with_ids: bool = False, kept: int = CHUNK_LIMIT) -> DataFrame:
    """Encode every whole text and decode it again. A worker keeps the ids of kept chunks of text at most.

    Returns one row per input row: the key, n_tokens, ids_sha256 (of the ids as little-endian unsigned
    32-bit integers), decoded_sha256 (of the decoded text's bytes), and with_ids the ids themselves. A null
    text counts as empty: no tokens, the hash of nothing. Repeated rows and null keys are kept as they
    come; other columns are not looked at. The vocabulary goes out as a broadcast variable: its size is
    fixed by the file, not by the data.
    """
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(*sent.value, kept)
        tokens = encoder.machine.tokens
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(lo, ROWS_AT_ONCE)
                n, ids_hash, text_hash, all_ids = [], [], [], []
                for value in part.column(1).to_pylist():
                    raw = encoder.encode(value or "")
                    ids = np.frombuffer(raw, "<u4")
                    digest, decoder = hashlib.sha256(), StreamDecoder(tokens)
                    for i in range(0, len(ids), 65_536):
                        digest.update(decoder.feed(ids[i : i + 65_536].tolist()).encode("utf-8"))
                    digest.update(decoder.feed((), final=True).encode("utf-8"))
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(raw).hexdigest())
                    text_hash.append(digest.hexdigest())
                    if with_ids:
                        all_ids.append(ids.astype(np.int32))
                out = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    out.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(key, text).mapInArrow(run, schema)


def decode_ids(df: DataFrame, ranks: dict[bytes, int], *, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, text) of the ids of each row; a null list gives an empty text, an unknown id an error."""
    spark = df.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast({v: k for k, v in ranks.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value in batch.column(1).to_pylist():
                decoder = StreamDecoder(sent.value)
                texts.append(decoder.feed(value or ()) + decoder.feed((), final=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    """The ranks and the pattern of an installed public tokenizer."""
    import public_tokenizers

    return _ranks_of(public_tokenizers.path(name)), public_tokenizers.PATTERN
