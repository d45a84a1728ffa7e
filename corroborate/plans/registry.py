"""Registry that keeps every named query next to its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from corroborate.session import cut_lineage, tune


TEXT_TABLES = {"documents", "pages", "conversations"}


def spread(df: DataFrame) -> DataFrame:
    """Spread a text table of few splits over the cores; large tables stay as read.

    Text work is heavy per row, and a file with one row group is one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Tables:
    """Lazy access to the driver's tables: ``t.documents`` reads one parquet file."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._made: dict[str, DataFrame] = {}

    def once(self, name: str, build: Callable[[Tables], DataFrame]) -> DataFrame:
        """Materialise an intermediate table that several branches of a query read."""
        if name not in self._made:
            self._made[name] = cut_lineage(build(self))
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(df) if name in TEXT_TABLES else df


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(tune(spark), sf_dir))


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, build, sql)
        return build

    return register
