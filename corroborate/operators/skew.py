"""Joins and positions that stay balanced when one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.session import cut_lineage


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join whose hot partitions Spark splits at run time.

    The session turns adaptive skew joins on and forces them also where the split costs a
    further shuffle, so one plan serves every size and neither side is read to look for
    hot keys first.
    """
    return left.join(right, key, how)


def prefix_scan(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    position: str = "rn",
    sums: dict[str, str] | None = None,
) -> DataFrame:
    """Positions and running sums per key under a total order.

    Rows are range-partitioned by key and order, numbered inside each range, and
    shifted by the totals of the earlier ranges, so a hot key spans many tasks.
    A null key is a key of its own.
    """
    sums = sums or {}
    placed = cut_lineage(
        df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(
            "_range", F.spark_partition_id()
        )
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("_pos", F.row_number().over(inside))
    for out, col in sums.items():
        local = local.withColumn(f"_run_{out}", F.sum(col).over(running))
    totals = placed.groupBy(*keys, "_range").agg(
        F.count(F.lit(1)).alias("_pos_total"),
        *[F.sum(col).alias(f"_total_{out}") for out, col in sums.items()],
    )
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("_range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shift = totals.select(
        *keys,
        "_range",
        F.coalesce(F.sum("_pos_total").over(earlier), F.lit(0)).alias("_pos_shift"),
        *[
            F.coalesce(F.sum(f"_total_{out}").over(earlier), F.lit(0)).alias(f"_shift_{out}")
            for out in sums
        ],
    )
    l, r = local.alias("l"), shift.alias("r")
    same = F.col("l._range") == F.col("r._range")
    for k in keys:
        same &= F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    joined = l.join(r, same)
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        (F.col("_pos") + F.col("_pos_shift")).cast("bigint").alias(position),
        *[(F.col(f"_run_{out}") + F.col(f"_shift_{out}")).alias(out) for out in sums],
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the greatest under ``order``; folds map-side, no window."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)
