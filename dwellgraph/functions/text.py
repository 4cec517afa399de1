"""Text and URL normalisation as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations and what they stand for.
ABBREVIATIONS = {"вул": "вулиця", "вулиці": "вулиця", "просп": "проспект", "кв": "квартира", "кімн": "кімнатна", "кім": "кімнатна", "м2": "м²"}
#: Query parameters that only track, and phrases that say nothing of a listing.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "yclid")
BOILERPLATE = ("синтетичне demo оголошення яке не описує реальну квартиру", "деталі за телефоном", "телефонуйте", "посередникам не турбувати")


def folded(text: Column) -> Column:
    """The text case-folded; only texts with other than ASCII letters leave the JVM.

    Compatibility composition and full case folding are what Spark has no function for.
    """

    def fold(texts):
        import unicodedata

        return texts.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")

    return F.when(text.rlike("[^\\x00-\\x7f]"), F.pandas_udf(fold, "string")(text)).otherwise(F.lower(text))


def norm_text(text: Column) -> Column:
    """Case-folded words with boilerplate left out and abbreviations spelled out, one space between them; null gives an empty text."""
    return words_of(folded(F.coalesce(text, F.lit(""))))


def norm_name(text: Column) -> Column:
    """norm_text of short names, in lower case only, so that all of it stays in the JVM."""
    return words_of(F.lower(F.coalesce(text, F.lit(""))))


def words_of(low: Column) -> Column:
    plain = F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}_²]+", " "))
    plain = F.regexp_replace(plain, "|".join(BOILERPLATE), " ")
    full = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    words = F.filter(F.split(plain, " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(full, w), w)), " ")


def contains_all(terms: str, columns: list[Column]) -> Column:
    """Whether each term stands, ignoring case, in one of the columns."""
    found = lambda term: reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False)) for c in columns])
    return reduce(lambda a, b: a & b, [found(t) for t in terms.split()], F.lit(True))


def canonical_query(query: Column) -> Column:
    """Query strings decoded, without tracking and blank parameters, sorted and encoded again."""
    tracking = TRACKING

    def one(text: str) -> str:
        from urllib.parse import parse_qsl, urlencode

        return urlencode(sorted((k, v) for k, v in parse_qsl(text) if k.casefold() not in tracking))

    def clean(queries):
        return queries.map(one, na_action="ignore")

    return F.pandas_udf(clean, "string")(query)


def canonical_url(url: Column) -> Column:
    """http(s) URLs as they are compared; '' for others and null.

    Scheme and host are in lower case, user, fragment and the scheme's own port go, slashes are single and
    none closes a path but the root's, tracking and blank parameters go and the others are sorted. Only
    query strings leave the JVM.
    """
    bare = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "(?s)#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    place = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)), "^.*@", "")
    port = F.regexp_extract(place, ":([0-9]+)$", 1)
    host = F.regexp_replace(place, ":[0-9]*$", "")
    own = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/{2,}", "/")
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/+$", ""))
    query = F.regexp_extract(bare, r"(?s)\?(.*)$", 1)
    kept = F.when(query == "", "").otherwise(canonical_query(query))
    tail = F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))
    whole = F.concat(scheme, F.lit("://"), host, F.when(own, "").otherwise(F.concat(F.lit(":"), port)), path, tail)
    return F.when(scheme.isin("http", "https") & (host != ""), whole).otherwise("")


def phone(digits: Column) -> Column:
    """The number with its country code from 9, 10 (with a leading 0) or more digits; else null."""
    bare = F.regexp_replace(digits, "[^0-9]", "")
    n = F.length(bare)
    full = F.when(n == 9, F.concat(F.lit("380"), bare)).when((n == 10) & bare.startswith("0"), F.concat(F.lit("38"), bare)).otherwise(bare)
    return F.when(F.length(full) >= 11, full)


#: What phones, e-mail addresses and handles look like, and the parts of a path that name contacts.
PHONE, EMAIL, HANDLE = r"(?<![0-9])(?:\+?38)?0?[0-9]{9,10}(?![0-9])", r"(?i)[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[a-zа-яіїєґ]{2,}", r"(?i)(?<![\p{L}\p{N}_])@[a-z0-9_]{5,32}"
CONTACT_KEYS = ("phone", "телефон", "email", "telegram", "contact", "контакт", "viber")
BUILDING = r"(?:^|\s)([0-9]{1,4}[а-яa-z]?)(?:\s|$)"


def contact_tokens(text: Column) -> Column:
    """The distinct phones, e-mail addresses and handles of a text, each with its kind before a colon."""
    t = F.coalesce(text, F.lit(""))
    # Most texts have no such signs, and are not searched.
    every = lambda pattern: F.when(t.rlike("[0-9]{9}") if pattern == PHONE else F.contains(t, F.lit("@")), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    phones = F.array_compact(F.transform(every(PHONE), phone))
    tagged = [F.transform(phones, lambda x: F.concat(F.lit("phone:"), x)), F.transform(every(EMAIL), lambda x: F.concat(F.lit("email:"), F.lower(x))), F.transform(every(HANDLE), lambda x: F.concat(F.lit("handle:"), F.lower(F.ltrim(x, F.lit("@")))))]
    return F.array_distinct(F.concat(*tagged))


def token_hashes(tokens: Column) -> Column:
    """The SHA-256 of each token, in order, so that contacts can be compared but not read."""
    return F.array_sort(F.transform(tokens, lambda x: F.sha2(x, 256)))


def building_number(*texts: Column) -> Column:
    """The first house number of the first normalised text that has one; else ''."""
    found = [F.regexp_extract(t, BUILDING, 1) for t in texts]
    return F.coalesce(*[F.when(x != "", x) for x in found], F.lit(""))


def geo_key(lat: Column, lon: Column, rooms: Column) -> Column:
    """Coordinates to three places and rooms as text; '' without coordinates."""
    return F.coalesce(F.when(lat.isNotNull() & lon.isNotNull(), F.format_string("%.3f:%.3f:%d", lat, lon, rooms)), F.lit(""))


def address_key(city: Column, district: Column, street: Column, building: Column, location: Column) -> Column:
    """City, district, street and house joined, the location in place of a missing house or street; '' if too little is known."""
    housed = F.when(building != "", joined_key(city, district, street, building)).otherwise(joined_key(city, district, street, building, location))
    return F.when((street != "") & ((building != "") | (location != "")), housed).when((district != "") & (location != ""), joined_key(city, district, location)).otherwise("")


def simhash64(normal: Column) -> Column:
    """The 64-bit SimHash of a normalised text's words over their BLAKE2b, in hex; '' without words.

    A bit is set if half of the words or more have it. Spark has no BLAKE2b, hence the Arrow function.
    """

    def hashed(texts):
        import hashlib

        import numpy as np

        known: dict[str, int] = {}

        def code(word: str) -> int:
            if word not in known:
                known[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            return known[word]

        def one(text: str) -> str:
            words = text.split()
            if not words:
                return ""
            bits = np.unpackbits(np.array([code(w) for w in words], ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            return np.packbits(2 * bits >= len(words)).tobytes().hex()

        return texts.map(one, na_action="ignore")

    return F.pandas_udf(hashed, "string")(normal)


def hamming64(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit numbers in hex; 64 if either is empty or null."""
    half = lambda x, at: F.conv(F.substring(x, at, 8), 16, 10).cast("bigint")
    apart = sum((F.bit_count(half(a, at).bitwiseXOR(half(b, at))) for at in (1, 9)), F.lit(0))
    return F.when((F.length(a) == 16) & (F.length(b) == 16), apart).otherwise(64)


def bits64(x: Column) -> Column:
    """The 64-bit number that 16 digits of hex stand for; null for another length."""
    half = lambda at: F.conv(F.substring(x, at, 8), 16, 10).cast("bigint")
    return F.when(F.length(x) == 16, F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def apart64(a: Column, b: Column) -> Column:
    """Differing bits of two numbers of bits64; 64 if either is null."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(64))


def sequence_ratio(left: Column, right: Column) -> Column:
    """0 to 1: the share of two texts in their longest matching blocks."""

    def ratio(left, right):
        from difflib import SequenceMatcher

        import pandas as pd

        return pd.Series([SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else 0.0 for a, b in zip(left, right, strict=True)], dtype=float)

    return F.pandas_udf(ratio, "double")(left, right)


def text_similarity(left: Column, right: Column, left_hash: Column, right_hash: Column) -> Column:
    """0 to 100 of two normalised texts: 65 parts their longest matching blocks, 35 parts their SimHashes; 0 if either is empty."""
    alike = 65 * sequence_ratio(left, right) + 0.35 * F.greatest(F.lit(0.0), 100 - 3.125 * hamming64(left_hash, right_hash))
    return F.when((left != "") & (right != ""), F.round(alike, 2)).otherwise(0.0)


#: Fixed value: the letters that a bag counts one by one; all others are counted together.
BAG = "абвгґдеєжзиіїйклмнопрстуфхцчшщьюяabcdefghijklmnopqrstuvwxyz0123456789 "


def letter_bag(normal: Column) -> Column:
    """How often each letter of BAG stands in a text, and last how many others it has."""
    found = [F.length(normal) - F.length(F.translate(normal, c, "")) for c in BAG]
    return F.array(*found, F.length(F.translate(normal, BAG, "")))


def text_similarity_at_most(left: Column, right: Column, left_hash: Column, right_hash: Column, left_bag: Column, right_bag: Column) -> Column:
    """A bound that text_similarity doesn't exceed: matching blocks hold no letter more often than both texts do."""
    shared = F.aggregate(F.zip_with(left_bag, right_bag, lambda a, b: F.least(a, b)), F.lit(0), lambda a, x: a + x)
    most = 65 * F.try_divide(2.0 * shared, F.length(left) + F.length(right)) + 0.35 * F.greatest(F.lit(0.0), 100 - 3.125 * hamming64(left_hash, right_hash))
    return F.when((left != "") & (right != ""), F.round(most, 2) + 0.01).otherwise(0.0)


def portable_simhash(text: Column, bits: int = 16) -> Column:
    """A SimHash of the text's distinct words over the first bits of their SHA-256, by Spark's functions only."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""))
    codes = F.transform(words, lambda w: F.conv(F.substring(F.sha2(w, 256), 1, bits // 4), 16, 10).cast("bigint"))
    vote = lambda i: F.aggregate(codes, F.lit(0), lambda a, c: a + F.when(F.shiftright(c, i).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1))
    return reduce(lambda a, b: a + b, [F.when(vote(i) > 0, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(bits)]).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def clamp(x: Column, low: int = 0, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def positive_numbers(csv: Column) -> Column:
    """The distinct positive whole numbers of a comma-separated text, in their order there; other parts are passed over."""
    parts = F.transform(F.split(F.coalesce(csv, F.lit("")), ","), lambda x: F.when(F.trim(x).rlike("^[0-9]{1,18}$"), F.trim(x).cast("bigint")))
    return F.array_distinct(F.filter(F.array_compact(parts), lambda x: x > 0))


def joined_parts(*parts: Column, by: str = ", ") -> Column:
    """The parts that are not blank, trimmed and joined."""
    return F.concat_ws(by, *[F.when(F.trim(p) != "", F.trim(p)) for p in parts])


def optional_number(value: Column) -> Column:
    """The text as a double; null if it is empty or none."""
    return value.try_cast("double")


def money(value: Column) -> Column:
    """A whole price with spaces between thousands."""
    told = F.concat(F.replace(F.format_number(value, 0), F.lit(","), F.lit(" ")), F.lit(" грн"))
    return F.coalesce(told, F.lit("ціну не вказано"))


def count_label(count: Column, one: str, few: str, many: str) -> Column:
    """The count with its word in the Slavic plural: one for 1, 21, ..., few for 2-4, 22-24, ..., else many."""
    ten, hundred = F.abs(count) % 10, F.abs(count) % 100
    word = F.when(hundred.between(11, 14), many).when(ten == 1, one).when(ten.between(2, 4), few).otherwise(many)
    return F.concat(count.cast("string"), F.lit(" "), word)


def price_range(low: Column, high: Column) -> Column:
    """Whole prices with spaces between thousands, as one figure if both are equal."""
    told = lambda c: F.replace(F.format_number(c, 0), F.lit(","), F.lit(" "))
    return F.concat(F.when(low == high, told(low)).otherwise(F.concat(told(low), F.lit("–"), told(high))), F.lit(" грн"))


def input_digest(text: Column) -> Column:
    """A short name of a text for logs that must not hold it."""
    return F.concat(F.lit("sha256:"), F.left(F.sha2(text, 256), F.lit(16)), F.lit(";chars:"), F.char_length(text).cast("string"))


def joined_key(*parts: Column) -> Column:
    """Parts joined by bars, of 320 characters at most; null counts as empty."""
    return F.left(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), F.lit(320))
