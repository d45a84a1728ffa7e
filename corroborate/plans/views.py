"""Evidence-shaped views of the driver tables, in Spark and in oracle SQL.

``documents`` plays the literature: the first line is the title, the rest the
abstract. Every Spark view has its SQL twin below it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.functions import text as X
from corroborate.plans.registry import Tables

NOW_YEAR = 2026

# SQL twin of functions.text.norm_quality on the characters of the driver data.
NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def norm_sql(column: str) -> str:
    return NORM.format(column)


def records(t: Tables) -> DataFrame:
    """documents as evidence records; topic = language, provider = source parity."""
    at = F.instr("text", "\n")
    return t.documents.select(
        F.col("doc_id").alias("record_id"),
        F.col("lang").alias("topic_id"),
        F.when(at > 0, F.substring("text", F.lit(1), at - 1)).otherwise(F.col("text")).alias("title"),
        F.when(at > 0, F.substring("text", at + 1, F.length("text"))).alias("abstract"),
        (F.lit(2000) + F.col("doc_id") % 25).cast("int").alias("year"),
        F.when(F.col("doc_id") % 7 != 0, F.col("n_chars")).alias("citations"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("10.5555/"), F.substring(F.md5("text"), 1, 12))).alias("doi"),
        F.when(
            F.col("doc_id") % 2 == 0, F.concat(F.lit("W"), F.col("n_chars") * 1000 + F.length("source"))
        ).alias("openalex_id"),
        F.when(F.col("doc_id") % 10 == 0, "review")
        .when(F.col("doc_id") % 10 == 1, "book-chapter")
        .otherwise("article")
        .alias("openalex_type"),
        F.when(F.col("doc_id") % 2 == 0, "openalex").otherwise("semantic-scholar").alias("source_api"),
        F.substring("source", 4, 10).cast("int").alias("query_index"),
        F.col("source"),
    )


RECORDS_SQL = """
records AS (
  SELECT doc_id AS record_id, lang AS topic_id,
    CASE WHEN position(chr(10) IN text) > 0 THEN substr(text, 1, position(chr(10) IN text) - 1) ELSE text END AS title,
    CASE WHEN position(chr(10) IN text) > 0 THEN substr(text, position(chr(10) IN text) + 1) END AS abstract,
    CAST(2000 + doc_id % 25 AS INTEGER) AS year,
    CASE WHEN doc_id % 7 <> 0 THEN n_chars END AS citations,
    CASE WHEN doc_id % 3 <> 0 THEN '10.5555/' || substr(md5(text), 1, 12) END AS doi,
    CASE WHEN doc_id % 2 = 0 THEN 'W' || CAST(n_chars * 1000 + length(source) AS VARCHAR) END AS openalex_id,
    CASE doc_id % 10 WHEN 0 THEN 'review' WHEN 1 THEN 'book-chapter' ELSE 'article' END AS openalex_type,
    CASE WHEN doc_id % 2 = 0 THEN 'openalex' ELSE 'semantic-scholar' END AS source_api,
    CAST(substr(source, 4) AS INTEGER) AS query_index,
    source
  FROM documents)
"""


TITLE_KEY_SQL = "trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))"


def keyed_records(t: Tables) -> DataFrame:
    """records plus the three duplicate keys, blank keys turned into null."""
    key = X.title_key(F.col("title"))
    return records(t).withColumn("title_key", F.when(key != "", key))


KEYED_SQL = f"""
{RECORDS_SQL.strip()},
keyed AS (SELECT *, nullif({TITLE_KEY_SQL}, '') AS title_key FROM records)
"""
