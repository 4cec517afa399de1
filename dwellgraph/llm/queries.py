"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellgraph.llm import licenses
from dwellgraph.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dwellgraph.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dwellgraph.llm.bpe import encode_documents, public_vocabulary

    return encode_documents(table(spark, sf_dir, "documents"), *public_vocabulary())


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dwellgraph.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dwellgraph.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dwellgraph.llm import pii

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.fit(docs))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dwellgraph.llm import toxicity as t

    docs = table(spark, sf_dir, "documents")
    weights = t.fit(t.learning_rows(docs, table(spark, sf_dir, "labels")))
    scored = t.score(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", t.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= t.THRESHOLD).cast("int").alias("predicted"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dwellgraph.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dwellgraph.llm import language as x

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = x.profiles(docs.where(~x.held_out(F.col("doc_id"))))
    return x.predict(docs.drop("lang"), known).select("doc_id", x.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dwellgraph.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dwellgraph.llm.embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dwellgraph.llm.sharding import assign

    return assign(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dwellgraph.llm.whitening import whitened_rows

    return whitened_rows(table(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dwellgraph.llm.alignment import alignment_digests, public_pair

    return alignment_digests(table(spark, sf_dir, "documents"), *public_pair())


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_decontaminate": op3_decontaminate,
    "op4_warc": op4_warc,
    "op5_pii": op5_pii,
    "op6_toxicity": op6_toxicity,
    "op7_near_dedup": op7_near_dedup,
    "op8_language": op8_language,
    "op9_licenses": op9_licenses,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_sharding": op11_sharding,
    "op12_whitening": op12_whitening,
    "op13_alignment": op13_alignment,
}

#: DuckDB SQL where SQL can express the operator at the cost of whole tables.
ORACLE_SQL: dict[str, str] = {
    "op9_licenses": licenses.oracle_sql(),
    "op4_warc": """
with p as (select page_id, coalesce(html, '') html, octet_length(encode(coalesce(html, ''))) payload_bytes from pages),
d as (select *, sha1(html) hex, min(page_id) over (partition by sha1(html)) first from p),
n as (select *, list_transform([0, 1, 2, 3], lambda i: ('0x' || substr(hex, 10 * i + 1, 10))::BIGINT) parts from d)
select page_id, payload_bytes::BIGINT payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((parts[(i // 8)::INT + 1] >> (35 - 5 * (i % 8))::INT) & 31) + 1)::INT, 1)), 'string_agg', '') payload_digest,
  case when page_id = first then 'response' else 'revisit' end record_type,
  case when page_id <> first then first end refers_to
from n""",
}
