"""Queries over the training-data operators, and the SQL they can be checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.leakage import leaked_items
from quillmesh.llm.mixing import mix_shares, mix_sources
from quillmesh.llm.neardup import duplicate_groups, near_duplicate_pairs
from quillmesh.llm.pairs import cut_responses, pair_defects
from quillmesh.llm.pii import personal_information, redact_tables
from quillmesh.llm.reading import reading_levels
from quillmesh.llm.truncation import length_limits
from quillmesh.llm.vectors import similar_pairs, similar_vectors
from quillmesh.session import table

# The pairs of TESTDATA.md: three-word sequences, similarity of at least 0.5.
SMALL_EDITS = {"threshold": 0.5, "words": 3, "bands": 80, "rows": 4}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(table(spark, d, "document_chunks"))


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar of every embedding, all similarities, for the vec_ids divisible by 100."""
    near = similar_vectors(table(spark, d, "embeddings"), "vec_id", "embedding")
    return near.select(F.col("id").cast("bigint").alias("vec_id"), F.col("neighbour").cast("bigint").alias("neighbour"), "similarity").where("vec_id % 100 = 0")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pair_defects(table(spark, d, "completions"), table(spark, d, "requests"))


def _texts(spark: SparkSession, d: str) -> dict:
    return {
        "messages": (table(spark, d, "messages"), "message_id", "content"),
        "requests": (table(spark, d, "requests"), "request_id", "user_input"),
        "completions": (table(spark, d, "completions"), "response_id", "content"),
    }


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_information(_texts(spark, d))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every record of the three tables that holds something, with placeholders in its place."""
    found = redact_tables(_texts(spark, d)).where(F.size("kinds") > 0)
    return found.select("source_table", "record_id", F.array_join("kinds", ",").alias("kinds"), "redacted")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return cut_responses(table(spark, d, "completions"), table(spark, d, "requests")).select("response_id")


def p4_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What shows each cut: its ending, what other texts show, or a limit of its source, with measure and length."""
    return cut_responses(table(spark, d, "completions"), table(spark, d, "requests"))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per provider_id the number of responses, of cut ones, and their share."""
    cut = p4_found(spark, d).withColumn("cut", F.lit(1)).hint("merge")
    every = table(spark, d, "completions").where("response_id is not null").select("response_id", "provider_id").distinct()
    return every.join(cut, "response_id", "left").groupBy("provider_id").agg(F.count("*").alias("n_responses"), F.sum(F.coalesce("cut", F.lit(0))).alias("n_cut"), F.avg(F.coalesce("cut", F.lit(0))).alias("cut_share"))


def p4_limits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "completions").select("response_id", "provider_id", "content").distinct()
    return length_limits(rows, "provider_id", "content")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, d, "source_documents"), **SMALL_EDITS)


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_groups(table(spark, d, "source_documents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).where("longest_run >= 12").select("doc_id", "item_id")


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "source_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_shares(table(spark, d, "documents"), table(spark, d, "source_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels")).select("doc_id", "reading_level")


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """How many documents and words each source has on each level."""
    level = reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))
    return level.hint("merge").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source", "reading_level").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"))


QUERIES = {f.__name__: f for f in (p1_found, p1_neighbours, p2_found, p3_found, p3_redacted, p4_found, p4_evidence, p4_rates, p4_limits, p5_found, p5_groups, p6_found, p6_scores, p7_mix, p7_shares, p8_found, p8_profile)}

_WORDS = r"regexp_extract_all(lower(content), '[\p{L}\p{N}]+')"
SQL = {
    "p5_found": f"""
        WITH d AS (SELECT DISTINCT doc_id, {_WORDS} AS w FROM source_documents WHERE content IS NOT NULL),
        s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM d WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
        SELECT x AS doc_a, y AS doc_b FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE c.c >= 0.5 * (p.n + q.n - c.c)""",
}
