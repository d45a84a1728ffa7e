"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_POSITIVE = 10_000
MAX_NEGATIVE = 20_000


def labelled_sample(labels: DataFrame, column: str, positive: int = MAX_POSITIVE, negative: int = MAX_NEGATIVE) -> DataFrame:
    """At most ``positive`` rows of label 1 and ``negative`` of label 0: doc_id, label.

    The sample is the rows with the smallest hash of doc_id, so it follows from the data
    alone. A doc_id with several labels has the largest one; null ids and labels are left out.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ones = known.filter("label = 1").orderBy(*order).limit(positive)
    return ones.unionByName(known.filter("label = 0").orderBy(*order).limit(negative))
