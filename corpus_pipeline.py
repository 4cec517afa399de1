"""A corpus pipeline: each stage reads what the one before it wrote.

All stages but the last return the columns of documents, extra ones too, whatever their names. A document with a
null key passes every stage that needs one as it is; a null or empty text is neither toxic, nor repeated, nor a
near copy, nor a leak, and has no tokens. Rows that repeat a key stay as many rows, unless a stage drops their
key. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellgraph.llm import bpe, decontaminate, line_dedup, near_dedup, toxicity
from dwellgraph.llm.common import fresh_name, materialize, table


#: Chunks of text whose ids a worker keeps: fewer than the operator's own, for workers still hold memory of the stages before.
KEPT_CHUNKS = 60_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under the threshold; the model is learned from the labelled documents that are left in."""
    weights = toxicity.fit(toxicity.learning_rows(docs, table(spark, sf_dir, "labels")))
    name = fresh_name("_score", docs)
    return toxicity.score(docs, weights, name=name).where(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the first of each group of similar lines only; those left without any line go."""
    return line_dedup.without_repeats(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a similarity of 0.8 over shingles of five words."""
    return near_dedup.first_of_each(docs, words=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, and the digests of the ids and of the text they decode to."""
    return bpe.encode_documents(docs, *bpe.public_vocabulary(), with_ids=True, kept=KEPT_CHUNKS)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("byte_bpe", encode),
]

#: SQL can express none of the learned or probabilistic stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
