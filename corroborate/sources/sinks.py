"""Writers: snapshots, scoped rewrites, guarded overwrites, bundles, refusal logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.functions import text as X
from corroborate.operators.relational import upsert_latest
from corroborate.session import cut_lineage


def write_snapshot(df: DataFrame, path: str, order: list[str]) -> None:
    """Deterministic full rewrite: range-partitioned and sorted by the key columns."""
    placed = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    placed.write.mode("overwrite").parquet(path)


def incomplete_grid(kept: DataFrame, expected: DataFrame, version: str) -> DataFrame:
    """Cells the kept part lacks, or that another version wrote."""
    absent = expected.join(kept.select("row", "segment").distinct(), ["row", "segment"], "left_anti")
    stale = kept.filter(F.col("version") != version).select("row", "segment")
    return absent.withColumn("violation", F.lit("absent")).unionByName(stale.withColumn("violation", F.lit("other_version")))


def write_scoped(df: DataFrame, path: str, expected: DataFrame, version: str) -> None:
    """Rewrite only the matrix rows in ``df``; refuse when the kept rows are unusable.

    ``expected``: row, segment of the whole grid.
    """
    spark = df.sparkSession
    rewritten = df.select("row").distinct()
    kept = spark.read.parquet(path).join(rewritten, "row", "left_anti")
    wanted = expected.join(rewritten, "row", "left_anti")
    if incomplete_grid(kept, wanted, version).limit(1).count():
        raise ValueError("the kept rows are incomplete or of another version; rewrite the whole grid")
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("row")
        .parquet(path)
    )


def guarded_overwrite(df: DataFrame, path: str, side_path: str) -> str:
    """Overwrite unless the new set is smaller than the one in place.

    Returns the path written; a smaller set goes to ``side_path`` for review.
    """
    spark = df.sparkSession
    fresh = cut_lineage(df)
    try:
        existing = spark.read.parquet(path).count()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        existing = None
    target = path if existing is None or fresh.count() >= existing else side_path
    fresh.write.mode("overwrite").parquet(target)
    return target


def merge_latest(batch: DataFrame, path: str, keys: list[str], order: str) -> None:
    """Upsert a batch into a table: read, merge, write beside it, then swap in.

    The merged set is cut from its input first, so the table can be overwritten.
    """
    spark: SparkSession = batch.sparkSession
    merged = upsert_latest(spark.read.parquet(path), batch, keys, order)
    cut_lineage(merged).write.mode("overwrite").parquet(path)


def datasheet_bundle(sheets: DataFrame, key: str) -> DataFrame:
    """One JSON document per row plus a manifest document that lists them."""
    documents = sheets.select(
        F.col(key).cast("string").alias("pack"), F.to_json(F.struct(*sheets.columns)).alias("document")
    )
    manifest = sheets.agg(
        F.count(F.lit(1)).alias("pack_count"), F.array_sort(F.collect_set(key)).alias("pack_ids")
    ).select(F.lit("manifest").alias("pack"), F.to_json(F.struct("pack_count", "pack_ids")).alias("document"))
    return manifest.unionByName(documents)


def rejection_log(refused: DataFrame, quote: Column, source: Column) -> DataFrame:
    """Refusals with both compared strings, raw and normalised, ready to append."""
    return (
        refused.withColumn("quote_raw", quote)
        .withColumn("source_raw", source)
        .withColumn("quote_normalized", X.norm_quality(quote))
        .withColumn("source_normalized", X.norm_quality(source))
    )


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
