"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellgraph.llm.common import fresh_name, prepare

#: Ranks kept in a profile, of a language and of a document alike.
RANKS = 300
#: N-grams have one to three characters, within words that are framed by a space on either side.
UNKNOWN = "und"
#: Labelled rows of a fit at most.
FIT_ROWS = 40_000
#: Runs of letters and of numerals that aren't digits (such as a superscript or a fraction); the latter part words.
_RUN = re.compile(r"[^\W\d_]+")
#: A gram is kept as one number: its code points, 21 bits each, first one highest; so numbers sort as grams do.
_BITS = 21


def words_of(text: str) -> list[str]:
    """The runs of letters. Only the few runs that hold something else are looked at letter by letter."""
    runs = _RUN.findall(text)
    if all(map(str.isalpha, runs)):
        return runs
    return [w for run in runs for w in ((run,) if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split(" ")) if w]


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(grams in order, their counts) over the texts' words, all at once: a gram spans no space but at its ends."""
    words = words_of("\n".join(texts).lower())
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    space = points == 32
    one, two = points << (2 * _BITS), points << _BITS
    pairs = one[:-1] | two[1:]
    code = np.concatenate([one[~space], pairs, (pairs[:-1] | points[2:])[~space[1:-1]]])
    code.sort()
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[starts], np.diff(np.append(starts, len(code)))


def ranked(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties in code point order."""
    return grams[np.argsort(-counts, kind="stable")[:RANKS]]


def profiles(labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = FIT_ROWS) -> dict[str, list[int]]:
    """Language -> its profile, from about rows rows with a language and a text at most, by a hash of key and text.

    Counts are made where the rows are and summed by n-gram; each language's best RANKS come back, which
    bounds the result by the number of languages. Rows with a null language or text are left out.
    """
    prepare(labelled.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[str]] = {}
            for language, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(language, []).append(value)
            for language, texts in by.items():
                grams, counts = gram_counts(texts)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(grams), pa.string()), pa.array(grams), pa.array(counts, pa.int64())], ["lang", "gram", "n"])

    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    if (total := known.count()) > rows:
        known = known.where(F.pmod(F.xxhash64(key, text), F.lit(total)) < rows)
    sums = known.select(F.col(lang).cast("string"), text).mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Spark keeps only the best ranks of each task before it brings a language's together.
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= RANKS)
    out: dict[str, list[int]] = {}
    for row in best.select("lang", "gram", "rank").orderBy("lang", "rank").collect():
        out.setdefault(row.lang, []).append(row.gram)
    return out


def predict(docs: DataFrame, known: dict[str, list[int]], *, text: str = "text") -> DataFrame:
    """docs with lang_pred and score by the least out-of-place distance of the whole text's profile.

    For each of the document's ranked n-grams the distance grows by the difference of its ranks in both
    profiles, or by RANKS if the language lacks it. The score is 1 less the best distance's share of the
    second best (1 if there is one language only). Equal distances go to the language first by name. A
    null text, one without letters, or an empty set of profiles gives `und` and 0. Columns of these names
    are replaced; others, repeated rows and nulls stay as they are.
    """
    prepare(docs.sparkSession)
    names = sorted(known)
    grams = np.unique(np.array([g for name in names for g in known[name]], np.int64))
    place = np.full((len(grams) + 1, max(1, len(names))), -1, np.int32)
    for j, name in enumerate(names):
        place[np.searchsorted(grams, np.array(known[name], np.int64)), j] = np.arange(len(known[name]))
    sent = docs.sparkSession.sparkContext.broadcast((names, grams, place))

    @F.pandas_udf("struct<lang_pred string, score double>")
    def predicted(texts):
        import pandas as pd

        names, grams, place = sent.value
        out = []
        for value in texts:
            own = ranked(*gram_counts([value])) if value and names else ()
            if not len(own):
                out.append((UNKNOWN, 0.0))
                continue
            at = np.searchsorted(grams, own)
            at[at == len(grams)] = 0
            rows = place[np.where(grams[at] == own, at, len(grams))]
            apart = np.where(rows < 0, RANKS, np.abs(rows - np.arange(len(own), dtype=np.int32)[:, None])).sum(axis=0)
            order = np.argsort(apart, kind="stable")
            rest = int(apart[order[1]]) if len(names) > 1 else 0
            out.append((names[order[0]], 1.0 - int(apart[order[0]]) / rest if rest else 1.0 if len(names) == 1 else 0.0))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    told = fresh_name("_p", docs)
    made = docs.withColumn(told, predicted(F.col(text)))
    return made.withColumns({"lang_pred": F.col(told)["lang_pred"], "score": F.col(told)["score"]}).drop(told)


def held_out(key: Column) -> Column:
    """Whether the key's crc32 is a multiple of 5; false for null."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))
