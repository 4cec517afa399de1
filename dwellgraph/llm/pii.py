"""Personal data: fixed patterns, and more spans by a semi-Markov conditional random field."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgraph.llm.common import prepare

#: The kinds of the fixed patterns, and the one that only the field finds.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: Base patterns (fixed values); runs of digits are entered at their start only, which finds the same.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Segments of an entity have so many tokens at most; texts, windows and rounds of the fit.
LONGEST = 33
FIT_ROWS = 3_000
FIT_WINDOWS = 1_500
ROUNDS = 3
#: Characters of a text that are learned from at most.
CUT = 4_000
RATE = 0.15
#: Tokens of the longest window that is learned from.
FIT_TOKENS = 90
#: A window is a run of chunks, parted by single spaces: of such that hold a digit or an @, or of such that spell out @ or . twice.
_CHUNK = re.compile(r"\S+")
_HOLDS = re.compile(r"[0-9@]")
_SIGNS = ".:=/_-"
_SPELT = re.compile(r"[\[({<]?(?:at|dot|AT|DOT)[\])}>]?")
_BRACKETED = re.compile(r"[\[({<](?:at|dot|AT|DOT)[\])}>]")
_OPENED, _CLOSED = re.compile(_BRACKETED.pattern), re.compile(rf"(?:{_BRACKETED.pattern})\Z")
_OUTSIDE = re.compile(r"[^A-Za-z0-9_.-]+\Z")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)
#: What the text says just before a window (a word and a sign of assignment) is a feature of its first segment.
_KEYED = re.compile(r"([A-Za-z_]+) ?[=:] ?[\"']?\Z")
#: Words that name a secret (fixed values), used to label secrets for the fit.
_SECRET = re.compile(r"\b(?:token|secret|password|passwd|api_key|apikey|key) ?[=:] ?[\"']?([A-Za-z0-9_]{16,128})(?![A-Za-z0-9_])")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans: leftmost, not overlapping within a kind, failing matches dropped."""
    found: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text, start - 1):
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            found.append((start, match.end(), "email"))
            last = match.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _spelt_run(text: str, chunks: list[tuple[int, int]], k: int) -> int:
    """How many chunks from the k-th on spell out signs, each a single space behind the one before; 0 if they spell fewer than two."""
    signs, n = 0, 0
    glued = True  # a chunk goes on a run if it is or begins with a sign, or if the one before is or ends with one
    for start, end in chunks[k : k + 2 * LONGEST]:
        alone = end - start <= 5 and _SPELT.fullmatch(text, start, end)
        if n and (text[start - 1] != " " or start - chunks[k + n - 1][1] != 1 or not (glued or alone or _OPENED.match(text, start, end))):
            break
        if not n and alone:
            break
        signs += 1 if alone else sum(1 for _ in _BRACKETED.finditer(text, start, end))
        glued = bool(alone) or bool(_CLOSED.search(text, max(start, end - 5), end))
        n += 1
    return n if signs >= 2 else 0


def _runs(text: str) -> Iterator[tuple[int, int]]:
    """The windows' borders. A chunk is looked at a bounded number of times, so the time is in proportion to the text."""
    chunks = [m.span() for m in _CHUNK.finditer(text)]
    spelt = bool(_BRACKETED.search(text)) or "dot" in text or "DOT" in text
    k = 0
    while k < len(chunks):
        start, end = chunks[k]
        if spelt and (n := _spelt_run(text, chunks, k)):
            k += n
            last = chunks[k - 1]
            tail = _OUTSIDE.search(text, max(last[0], last[1] - 40), last[1])
            yield start, tail.start() if tail and tail.start() > start else last[1]
            continue
        k += 1
        if not _HOLDS.search(text, start, end):
            continue
        while k < len(chunks) and chunks[k][0] - end == 1 and text[end] == " ":
            if _HOLDS.search(text, *chunks[k]):
                end = chunks[k][1]
            elif text[chunks[k][0]] in _SIGNS and chunks[k][1] - chunks[k][0] == 1:
                end = chunks[k][1]
            else:
                break
            k += 1
        yield start, end


def windows(text: str) -> Iterator[tuple[int, list[str], str]]:
    """(offset, tokens, word) of the stretches of a text in which entities are looked for; word is the name that is assigned to, if any.

    An entity has a digit or a spelt or written @, so of a long window only the tokens within LONGEST of one are
    given: no entity reaches to the edge of such a stretch, so the best segmentation is the same.
    """
    for start, end in _runs(text):
        whole, at = text[start:end], start
        before = _KEYED.search(text, max(0, at - 40), at)
        # A window may itself begin with the name and the sign.
        inner = re.match(r"([A-Za-z_]+)[=:][\"']?", whole[:60])
        if inner and not before:
            before, at, whole = inner, at + inner.end(), whole[inner.end() :]
        word, tokens = before[1].lower() if before else "", _TOKEN.findall(whole)
        if len(tokens) <= 2 * LONGEST:
            yield at, tokens, word
            continue
        low, high, offset, done = 0, 0, at, 0
        for i, t in enumerate(tokens):
            if t[0] in "0123456789@" or t in ("at", "AT", "At", "aT"):
                if i - LONGEST > high and high:
                    yield offset, tokens[low:high], word if not low else ""
                if not high or i - LONGEST > high:
                    low = max(0, i - LONGEST)
                    offset += sum(map(len, tokens[done:low]))
                    done = low
                high = min(len(tokens), i + LONGEST + 1)
        if high:
            yield offset, tokens[low:high], word if not low else ""


class Window:
    """A window's tokens with what tells in constant time whether tokens i..j can be an entity at all."""

    def __init__(self, tokens: list[str], word: str = ""):
        self.tokens, self.word = tokens, word
        self.kinds = ["d" if t.isdigit() and t.isascii() else "a" if t.isalpha() and t.isascii() else "u" if t.isalnum() else t for t in tokens]
        self.digits, self.ats, self.dots, self.wide = [0], [0], [0], [0]
        for t, k in zip(tokens, self.kinds, strict=True):
            low = t.lower() if k == "a" else t
            self.digits.append(self.digits[-1] + (len(t) if k == "d" else 0))
            self.ats.append(self.ats[-1] + (low in ("@", "at")))
            self.dots.append(self.dots[-1] + (low in (".", "dot", ",")))
            self.wide.append(self.wide[-1] + (len(t) if k in "da_" else 0))

    def fits(self, i: int, j: int) -> bool:
        """Whether tokens[i:j] has what every entity has; entities begin and end on no space, and not within a run of letters and digits."""
        first, last = self.kinds[i], self.kinds[j - 1]
        if last not in "da" or not (first in "da" or first in "+("):
            return False
        if (i and first in "da" and self.kinds[i - 1] in "da_") or (j < len(self.kinds) and self.kinds[j] in "da_"):
            return False
        digits = self.digits[j] - self.digits[i]
        if 7 <= digits <= 19 and j - i <= 33:
            return True
        if digits >= 4 and self.dots[j] - self.dots[i] >= 3 and digits <= 12:
            return True
        if self.ats[j] - self.ats[i] == 1 and self.dots[j] - self.dots[i] >= 1 and first == "a":
            return True
        return self.wide[j] - self.wide[i] >= 16 and all(k in "da_" for k in self.kinds[i:j]) and digits > 0

    def features(self, i: int, j: int) -> tuple[str, ...]:
        """Features of the whole candidate segment tokens[i:j]."""
        part, kinds = self.tokens[i:j], self.kinds[i:j]
        spelt = ["@" if k == "a" and t.lower() == "at" else "." if k == "a" and t.lower() == "dot" else k for t, k in zip(part, kinds, strict=True)]
        shape = re.sub(r"(.)\1+", r"\1", "".join(spelt))
        bare = re.sub(r"[ \[\](){}<>]+", "", shape)
        digits = self.digits[j] - self.digits[i]
        before, after = self.kinds[i - 1] if i else "^", self.kinds[j] if j < len(self.kinds) else "$"
        groups = [t for t, k in zip(part, kinds, strict=True) if k == "d"]
        whole = "".join(groups)
        valid = "luhn" if 12 <= digits <= 19 and luhn(whole) else "none"
        octets = "octets" if len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups) else "none"
        size = "long" if self.wide[j] - self.wide[i] >= 24 else "short"
        mixed = "mixed" if all(k in "da_" for k in kinds) and "d" in kinds and "a" in kinds else "plain"
        lengths = "-".join(str(min(len(g), 5)) for g in groups) if len(groups) <= 6 else "many"
        word = self.word if i == 0 else ""
        return (f"s{shape[:24]}", f"b{bare[:16]}", f"n{min(digits, 20)}", f"g{lengths}", f"e{before}|{after}", f"v{valid}", f"o{octets}{bare == 'd.d.d.d'}", f"f{kinds[0]}", f"w{word}", f"m{mixed}{size}", f"wm{word}{mixed}{size}")


class SemiCrf:
    """Weights of (kind, feature), kind 0 being a single token outside any entity."""

    def __init__(self, weights: dict[tuple[int, str], float] | None = None):
        self.weights = weights or {}

    def segment_score(self, kind: int, features: tuple[str, ...]) -> float:
        get = self.weights.get
        return sum(get((kind, f), 0.0) for f in features)

    def ending(self, window: Window, j: int) -> Iterator[tuple[int, int, tuple[str, ...], float]]:
        """The candidate segments that end at j: (start, kind, features, score)."""
        own = window.tokens[j - 1]
        single = (f"t{window.kinds[j - 1]}", f"l{min(len(own), 20)}{window.kinds[j - 1]}", f"w{window.word if j == 1 else ''}")
        yield j - 1, 0, single, self.segment_score(0, single)
        for i in range(j - 1, max(0, j - LONGEST) - 1, -1):
            if window.digits[j] - window.digits[i] > 19 and window.wide[j] - window.wide[i] > 128:
                break
            if window.fits(i, j):
                features = window.features(i, j)
                for k in range(1, len(ALL_KINDS) + 1):
                    yield i, k, features, self.segment_score(k, features)

    def decode(self, tokens: list[str], word: str = "") -> list[tuple[int, int, int]]:
        """The best segmentation's entities (start, end, kind), boundaries and kinds chosen together."""
        window = Window(tokens, word)
        best, back = [0.0] + [-np.inf] * len(tokens), [(0, 0)] * (len(tokens) + 1)
        for j in range(1, len(tokens) + 1):
            for i, k, _, score in self.ending(window, j):
                if best[i] + score > best[j]:
                    best[j], back[j] = best[i] + score, (i, k)
        out, j = [], len(tokens)
        while j:
            i, k = back[j]
            if k:
                out.append((i, j, k))
            j = i
        return out[::-1]

    def learn(self, tokens: list[str], word: str, gold: list[tuple[int, int, int]], rate: float) -> None:
        """One gradient step on the log-likelihood of the gold segmentation."""
        window, n = Window(tokens, word), len(tokens)
        segments = [[], *(list(self.ending(window, j)) for j in range(1, n + 1))]
        alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        alpha[0] = beta[n] = 0.0
        for j in range(1, n + 1):
            alpha[j] = np.logaddexp.reduce([alpha[i] + s for i, _, _, s in segments[j]])
        for j in range(n, 0, -1):
            for i, _, _, s in segments[j]:
                beta[i] = np.logaddexp(beta[i], beta[j] + s)
        inside = {t for i, j, _ in gold for t in range(i, j)}
        wanted = {(i, j, k) for i, j, k in gold} | {(t, t + 1, 0) for t in range(n) if t not in inside}
        for j in range(1, n + 1):
            for i, k, features, s in segments[j]:
                step = ((i, j, k) in wanted) - float(np.exp(alpha[i] + s + beta[j] - alpha[n]))
                if abs(step) > 1e-4:
                    for f in features:
                        self.weights[k, f] = self.weights.get((k, f), 0.0) + rate * step


def _gold(offset: int, tokens: list[str], spans: list[Span]) -> list[tuple[int, int, int]] | None:
    """The spans inside a window in tokens; None if their borders are none of tokens, or they overlap or are long."""
    edges, at = {}, offset
    for i, t in enumerate(tokens):
        edges[at] = i
        at += len(t)
    edges[at] = len(tokens)
    inside = [s for s in spans if offset <= s[0] < at]
    if any(s[0] not in edges or s[1] not in edges for s in inside):
        return None
    out = [(edges[s[0]], edges[s[1]], ALL_KINDS.index(s[2]) + 1) for s in inside]
    ok = all(j - i <= LONGEST for i, j, _ in out) and all(a[1] <= b[0] for a, b in zip(out, out[1:], strict=False))
    return out if ok else None


def disguised(entity: str, kind: str, rng: random.Random) -> str:
    """The entity as people write it to be overlooked: signs spelt out, other separators, a phone without its plus."""
    if kind == "email":
        at = rng.choice(["@", " at ", " (at) ", "(at)", "[at]", " [at] ", " AT "])
        dot = rng.choice([".", " dot ", " (dot) ", "(dot)", "[dot]", " [dot] ", " DOT "]) if at != "@" else rng.choice([" dot ", "(dot)", "[dot]"])
        name, _, domain = entity.partition("@")
        return name + at + domain.replace(".", dot)
    if kind == "ip":
        return entity.replace(".", rng.choice([" . ", "[.]", "(.)", " dot ", "[dot]", ". ", ","]))
    digits = "".join(c for c in entity if c.isdigit())
    if kind == "card":
        if rng.random() < 0.2:
            return " . ".join(digits[i : i + 4] for i in range(0, len(digits), 4))
        return rng.choice([".", "/", "_", ":", "  ", " - "]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == "phone":
        sep = rng.choice([" ", "-", ".", "/", ""])
        head = rng.choice([f"({digits[1:4]}) ", f"{digits[1:4]}{sep}", f"{digits[0]} ({digits[1:4]}) ", f"00{digits[0]} {digits[1:4]} "])
        return head + digits[4:7] + (sep or "-") + digits[7:]
    return entity


def _examples(text: str, spans: list[Span]) -> Iterator[tuple[list[str], str, list[tuple[int, int, int]]]]:
    for offset, tokens, word in windows(text):
        gold = _gold(offset, tokens, spans)
        if gold is not None and len(tokens) <= FIT_TOKENS:
            yield tokens, word, gold


def train(texts: list[str], *, seed: int = 5) -> SemiCrf:
    """Learn from texts whose base spans are the labels, and from the same texts with entities disguised.

    Each entity of the fixed patterns is also seen in other spellings that these patterns miss, put in its
    place with the words around it and labelled as before; so are strings that a word such as token or
    password is assigned, as secrets. So the field learns what entities are made of. Windows with digits
    enough for a phone that no label covers are left out, for they may hold what the patterns miss.
    """
    rng, seen = random.Random(seed), []
    for text in texts:
        base = base_spans(text)
        labelled = sorted(base + [(m.start(1), m.end(1), "secret") for m in _SECRET.finditer(text)])
        for tokens, word, gold in _examples(text, labelled):
            # What has the form of a card but fails its check is no entity; other digits without a label may be one.
            rest = "".join("|" if any(a <= i < b for a, b, _ in gold) else t for i, t in enumerate(tokens))
            doubt = _CARD.sub(lambda m: "" if sum(c.isdigit() for c in m[0]) >= 12 else m[0], rest)
            if sum(c.isdigit() for c in doubt) < 9:
                seen.append((tokens, word, gold))
        for start, end, kind in base:
            for _ in range(2):
                made = disguised(text[start:end], kind, rng)
                before, after = text[max(0, start - 30) : start], text[end : end + 30]
                seen += [x for x in _examples(before + made + after, [(len(before), len(before) + len(made), kind)]) if x[2]]
    rng.shuffle(seen)
    # Windows without an entity are many and alike; they are kept to as many as there are others.
    some, none = [x for x in seen if x[2]], [x for x in seen if not x[2]]
    seen = some[:FIT_WINDOWS] + none[: max(200, min(len(some), FIT_WINDOWS))]
    rng.shuffle(seen)
    crf = SemiCrf()
    for i in range(ROUNDS):
        for tokens, word, gold in seen:
            crf.learn(tokens, word, gold, RATE / (1 + i))
    return crf


def fit(docs: DataFrame, *, text: str = "text", rows: int = FIT_ROWS) -> SemiCrf:
    """The field, learned from at most about rows texts with a digit or an @, those with the smallest hashes; empty without such texts."""
    some = docs.select(F.col(text).alias("t")).where(F.col("t").rlike("[0-9@]")).withColumn("h", F.xxhash64("t"))
    total = some.count()
    if total > rows:
        some = some.where(F.pmod("h", F.lit(total)) < rows)
    # Only what stands around digits and @ comes to the driver, and of a text no more than CUT characters.
    parts = F.regexp_extract_all("t", F.lit(r"((?:\S{1,20}\s){0,3}\S{0,60}[0-9@]\S{0,140}(?: \S{0,60}[0-9@]\S{0,140}){0,20}(?:\s\S{1,20}){0,2})"), F.lit(1))
    cut = some.select("h", F.substring(F.concat_ws("\n", parts), 1, CUT).alias("t"))
    return train([r.t for r in cut.distinct().orderBy("h", "t").limit(2 * rows).collect()])


def find(docs: DataFrame, crf: SemiCrf, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, over the whole text.

    The counts n_email to n_phone and the digest are of the base spans. spans holds them and the field's
    spans that overlap no base span, as kind:start:end by start and then kind, comma-joined, in code points,
    end exclusive; n_spans is their number. The field also finds secrets. A null or empty text has no spans.
    Repeated rows and null keys are kept; other columns are not looked at. Windows are decoded in time and
    memory that grow with their length, each entity having LONGEST tokens at most.
    """
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(crf.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = SemiCrf(sent.value), {}
        for batch in batches:
            out: list[tuple] = []
            for value in batch.column(1):
                text_ = value.as_py() or ""
                base = base_spans(text_)
                more = []
                for offset, tokens, word in windows(text_):
                    shape = ("".join(tokens), word)
                    got = known.get(shape)
                    if got is None:
                        at = list(accumulate(map(len, tokens), initial=0))
                        got = [(at[i], at[j], ALL_KINDS[k - 1]) for i, j, k in model.decode(tokens, word)]
                        if len(known) > 20_000:
                            known.clear()
                        if len(shape[0]) <= 200:
                            known[shape] = got
                    more += [(offset + i, offset + j, k) for i, j, k in got]
                taken, last, n, order = [], -1, 0, sorted(base)
                for s in sorted(more):
                    while n < len(order) and order[n][0] < s[1]:
                        last = max(last, order[n][1])
                        n += 1
                    if last <= s[0]:
                        taken.append(s)
                told = sorted(base + taken, key=lambda x: (x[0], ALL_KINDS.index(x[2])))
                join = lambda spans: ",".join(f"{k}:{i}:{j}" for i, j, k in spans)
                out.append((*(sum(s[2] == k for s in base) for k in KINDS), hashlib.sha256(join(base).encode()).hexdigest(), join(told), len(told)))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint")
