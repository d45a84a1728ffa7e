"""Training-data pipeline: keep readable, harmless, distinct, clean documents and pack them.

Every stage reads the documents that the one before kept. A row is known by its doc_id and
text together; rows equal in both are copies of each other.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm.jaccard_join import similar_documents
from corroborate.llm.positional_index import find_contamination
from corroborate.llm.queries import remainder, table, tokenizer_path, toxicity_model
from corroborate.llm.rank_order import UNKNOWN, identify, learn_profiles
from corroborate.llm.sum_of_squares import pack_documents
from corroborate.llm.toxic_segments import score
from corroborate.session import scratch_path, tune

LEAST_LIKENESS = 0.2  # of a document to the profile of its language
TOXIC = 0.3

# A row's keys; none is null, so equal rows meet in plain joins.
ROW = ["_id", "_null", "_text"]


def _keys(text_key: Column) -> list[Column]:
    null = F.col("doc_id").isNull()
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("_id"), null.alias("_null"), text_key.alias("_text")]


def _keyed(docs: DataFrame) -> DataFrame:
    """Whole rows as one column, safe from clashing names, beside their keys."""
    return docs.select(F.struct(*docs.columns).alias("_row"), *_keys(F.xxhash64("text")))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters, and those unlike every language."""
    profiles = learn_profiles(docs.filter(remainder(3) != 1)).toPandas()
    named = identify(docs.select("text", F.struct(*docs.columns).alias("_row")), profiles)
    return named.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LIKENESS)).select("_row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are likely toxic."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("text", F.struct(*docs.columns).alias("_row")), model)
    return scored.filter(F.col("score") < TOXIC).select("_row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each component of near copies.

    Two documents are near copies where they share at least 80 of 100 of their distinct
    five-word shingles (Jaccard); documents of fewer words where all their words are the same.
    Documents without words are no copies of each other; of equal rows one stays.
    """
    found = similar_documents(docs.select("doc_id", "text"), width=5, num=80, den=100)
    null = F.col("doc_id").isNull()
    rank = F.struct(null.alias("null"), F.col("doc_id").alias("doc_id"), F.col("text_key").alias("text_key"))
    first = found.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min(rank).alias("first"))
    first = first.select("first.doc_id", "first.text_key")
    kept = first.unionByName(found.filter(F.col("component").isNull()).select("doc_id", "text_key")).distinct()
    kept = kept.select(*_keys(F.col("text_key")))
    return _keyed(docs).join(kept, ROW, "left_semi").dropDuplicates(ROW).select("_row.*")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more lies in benchmark passages."""
    found = find_contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    dirty = found.filter("contaminated").select("doc_id", "text_key").distinct()
    dirty = dirty.select(*_keys(F.col("text_key")))
    return _keyed(docs).join(dirty, ROW, "left_anti").select("_row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place the token pieces of all documents in sequences."""
    return pack_documents(docs.select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _tuned(stage: Stage) -> Stage:
    """``stage`` under the settings it assumes, also where it is called without ``run``."""

    @functools.wraps(stage)
    def run_tuned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(tune(spark), docs, sf_dir)

    return run_tuned


STAGES: list[tuple[str, Stage]] = [
    ("language", _tuned(identify_language)),
    ("toxicity", _tuned(drop_toxic)),
    ("near_copies", _tuned(drop_near_copies)),
    ("benchmark", _tuned(drop_benchmark)),
    ("packing", _tuned(pack)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each is written and read again."""
    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
    return docs
