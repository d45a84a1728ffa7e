"""Grounding queries: passages in documents, spans, audits, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from corroborate.operators import grounding as G
from corroborate.plans.registry import Tables, query
from corroborate.plans.views import norm_sql

_HITS_SQL = f"""
WITH p AS (SELECT item_id, {norm_sql('text')} AS needle FROM benchmark),
d AS (SELECT doc_id, lang, text, {norm_sql('text')} AS hay FROM documents),
m AS (
  SELECT item_id, doc_id, lang, text, needle,
    regexp_extract(lower(text), replace(needle, ' ', '[^a-z0-9]+')) AS hit
  FROM d, p WHERE needle <> '' AND contains(hay, needle)),
hits AS (
  SELECT item_id, doc_id, lang, text,
    CAST(position(hit IN lower(text)) - 1 AS BIGINT) AS span_start,
    CAST(position(hit IN lower(text)) - 1 + length(hit) AS BIGINT) AS span_end
  FROM m)
"""


def hits(t: Tables):
    found = G.find_passages(
        t.benchmark.select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage")),
        t.documents.select("doc_id", "text"),
    )
    return found.select(
        F.col("passage_id").alias("item_id"),
        "doc_id",
        F.col("start").alias("span_start"),
        F.col("end").alias("span_end"),
        "quote",
    )


@query(
    "find_passages",
    _HITS_SQL
    + """SELECT item_id, doc_id, span_start, span_end,
    substr(text, span_start + 1, span_end - span_start) AS quote FROM hits""",
)
def find_passages(t: Tables):
    return hits(t)


@query(
    "ground_benchmark",
    _HITS_SQL
    + """SELECT lang, count(*) AS hits, count(DISTINCT item_id) AS passages,
    count(DISTINCT doc_id) AS documents, CAST(min(span_start) AS BIGINT) AS first_start,
    CAST(sum(span_end - span_start) AS BIGINT) AS grounded_chars
    FROM hits GROUP BY lang""",
)
def ground_benchmark(t: Tables):
    return (
        hits(t)
        .join(t.documents.select("doc_id", "lang"), "doc_id")
        .groupBy("lang")
        .agg(
            F.count(F.lit(1)).alias("hits"),
            F.countDistinct("item_id").alias("passages"),
            F.countDistinct("doc_id").alias("documents"),
            F.min("span_start").alias("first_start"),
            F.sum(F.col("span_end") - F.col("span_start")).alias("grounded_chars"),
        )
    )
