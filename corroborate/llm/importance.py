"""Importance resampling of raw text towards a target.

Two bags of hashed words and word pairs are estimated, of the target and of all raw text.
A document's importance is the ratio of its likelihoods. Adding Gumbel noise to its
logarithm and keeping the k largest sums draws k documents without replacement, with
chances in proportion to their importance.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.llm import words as W
from corroborate.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 14
SMOOTHING = 1.0


def _buckets(texts: W.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every word and every pair of words."""
    w = W.Words(texts)
    pair_doc, pair = W.shingles(w, 2, whole_if_short=False)
    bucket = np.concatenate([w.hash, pair]) >> np.uint64(64 - (BUCKETS.bit_length() - 1))
    return np.concatenate([w.doc, pair_doc]), bucket.astype(np.int64)


def bucket_counts(docs: DataFrame, column: str = "text") -> np.ndarray:
    """Occurrences of each bucket in all texts: one vector a task, summed by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, texts in W.text_slices(batch.column(0)):
                total += np.bincount(_buckets(texts)[1], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = docs.select(column).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Logarithm of target over raw probability of each bucket, both smoothed."""
    share = lambda c: np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * len(c)))
    return share(target) - share(raw)


def importance(docs: DataFrame, ratio: np.ndarray, seed: int = 0) -> DataFrame:
    """Add n_grams, log_weight and gumbel_key to every row (columns of these names are replaced).

    A null or empty text has weight 0. The noise follows from seed and doc_id, so repeated
    rows share it, and a task that runs again draws the same.
    """

    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, weight = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for first, texts in W.text_slices(pa.array(batch, pa.string())):
                doc, bucket = _buckets(texts)
                here = slice(first, first + len(texts))
                n[here] = np.bincount(doc, minlength=len(texts))
                weight[here] = np.bincount(doc, ratio[bucket], len(texts))
            yield pd.DataFrame({"n_grams": n, "log_weight": weight})

    made = ("n_grams", "log_weight", "gumbel_key", "_made")
    kept = [c for c in docs.columns if c.lower() not in made]
    weighed = docs.select(*[docs[f"`{c}`"] for c in kept], F.pandas_udf(weigh, "n_grams long, log_weight double")(docs["text"]).alias("_made"))
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("gumbel"), F.col("doc_id")), 11) + 0.5) / float(1 << 53)
    return weighed.select(
        *[F.col(f"`{c}`") for c in kept],
        "_made.n_grams",
        "_made.log_weight",
        (F.col("_made.log_weight") - F.log(-F.log(unit))).alias("gumbel_key"),
    )


def take_largest(rows: DataFrame, key: str, k: int) -> DataFrame:
    """Add ``selected``: whether the row's key is among the k largest; ties with the last one count.

    Keys count as multiples of 2**-32 and lie within 2**31. The limit is found by narrowing
    its 64 bits by 16 a pass, from counts of at most 65,536 groups; no task sorts the table.
    """
    if k <= 0:
        return rows.withColumn("selected", F.lit(False))
    keyed = rows.withColumn("_bits", F.floor(F.col(key) * float(1 << 32)).cast("long"))
    narrow = cut_lineage(keyed.select("_bits"))
    prefix, left = None, k
    for shift in (48, 32, 16, 0):
        part = F.shiftright("_bits", shift)
        inside = narrow if prefix is None else narrow.filter(F.shiftright("_bits", shift + 16) == prefix)
        counts = inside.groupBy(part.alias("part")).count().toPandas().sort_values("part", ascending=False)
        if prefix is None and counts["count"].sum() <= k:
            return rows.withColumn("selected", F.lit(True))
        reached = counts["count"].cumsum().to_numpy()
        at = int(np.searchsorted(reached, left))
        left -= int(reached[at - 1]) if at else 0
        prefix = int(counts["part"].iloc[at])
    return keyed.withColumn("selected", F.col("_bits") >= prefix).drop("_bits")



def resample(docs: DataFrame, target: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Draw ``share`` of all documents towards ``target`` (same text column).

    Adds n_grams, log_weight, gumbel_key and selected to the rows of ``docs``. The raw
    model covers all of ``docs``; ``target`` is bounded by its caller.
    """
    ratio = log_ratio(bucket_counts(target), bucket_counts(docs))
    weighed = importance(docs, ratio, seed)
    return take_largest(weighed, "gumbel_key", round(share * docs.count()))
