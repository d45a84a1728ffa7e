"""Bottom-k sketches of shingle hashes.

A sketch is the k smallest hashes of a document's word shingles. Sketches of parts merge
to the sketch of the whole. Two sketches estimate resemblance and containment, one alone
the number of distinct shingles; with fewer than k shingles all of these are exact.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.llm import words as W

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = 128
SHINGLE_WORDS = 5
RANGE_BYTES = 32 << 20  # of text


def sketches(column: pa.Array, k: int, width: int) -> list[np.ndarray]:
    """Sketch of each text: at most ``k`` distinct hashes, ascending; a null text has none."""
    out: list[np.ndarray] = []
    for _, texts in W.text_slices(column):
        doc, value = W.distinct_per_doc(*W.shingles(W.Words(texts), width))
        limits = np.searchsorted(doc, np.arange(len(texts) + 1))
        out += [value[a : min(b, a + k)] for a, b in zip(limits[:-1].tolist(), limits[1:].tolist())]
    return out


def merge(parts: list[np.ndarray], k: int) -> np.ndarray:
    """Sketch of the union of the sketched sets."""
    return np.unique(np.concatenate(parts))[:k] if parts else np.zeros(0, np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Estimated share of common shingles; two empty sets are alike."""
    both = np.sort(np.concatenate([a, b]))
    twice = np.zeros(len(both), bool)
    twice[1:] = both[1:] == both[:-1]
    distinct = np.cumsum(~twice)
    if not len(both):
        return 1.0
    return float(twice[distinct <= k].sum() / min(k, distinct[-1]))


def distinct_count(a: np.ndarray, k: int) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / float(a[-1])


def containment(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has; an empty set is contained."""
    n = distinct_count(a, k)
    if not n:
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct_count(merge([a, b], k), k) / n)


def write_sketch(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def read_sketch(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def sketch_documents(docs: DataFrame, text: str = "text", k: int = K, width: int = SHINGLE_WORDS) -> DataFrame:
    """Add ``sketch`` and ``n_distinct`` to every row; a null or empty text has an empty sketch."""

    @F.pandas_udf("sketch string, n_distinct double")
    def of(texts: pd.Series) -> pd.DataFrame:
        made = sketches(pa.array(texts, pa.string()), k, width)
        return pd.DataFrame({"sketch": [write_sketch(s) for s in made], "n_distinct": [distinct_count(s, k) for s in made]})

    kept = [c for c in docs.columns if c.lower() not in ("sketch", "n_distinct", "_made")]
    made = docs.select(*[docs[f"`{c}`"] for c in kept], of(docs[f"`{text}`"]).alias("_made"))
    return made.select(*[F.col(f"`{c}`") for c in kept], "_made.sketch", "_made.n_distinct")


def merge_parts(parts: DataFrame, key: str, k: int = K) -> DataFrame:
    """key, sketch of all parts of a key; null keys are a key of their own.

    Parts meet within their batch first, so a key with very many parts reaches the last
    merge as one sketch a batch.
    """
    schema = parts.select(key, F.col("sketch").cast("string").alias("sketch")).schema

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        grouped = frame.groupby(key, dropna=False, sort=False)["sketch"]
        merged = grouped.agg(lambda s: write_sketch(merge([read_sketch(x) for x in s if x], k)))
        return merged.reset_index()

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(fold, batches)

    return parts.select(key, "sketch").mapInPandas(within, schema).groupBy(key).applyInPandas(fold, schema)


def fingerprint_edits(docs: DataFrame, k: int = K, width: int = SHINGLE_WORDS) -> DataFrame:
    """Sketch every text, its half-replaced copy, and compare both with their neighbours.

    The later half of a text (in code points) gives way to the start of the text that
    follows by ascending doc_id, null ids first; the first text follows the last. Rows of
    one doc_id follow each other by a hash of their texts. Null texts count as empty.

    Texts move once: rows go to ranges of doc_id, and the first document of a range also
    goes to the range before, where it only serves as the last one's neighbour. The limits
    of the ranges are doc_ids of the table, a few bytes for every ``RANGE_BYTES`` of text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    stats = rows.agg(F.sum(F.octet_length("text")), F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    parts = max(1, -(-(stats[0] or 0) // RANGE_BYTES))
    shares = [i / parts for i in range(1, parts)]
    found = rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * parts))).first()[0] if shares else None
    limits = np.array(sorted({c for c in found or [] if c > stats[1]}), np.int64)
    first = None if stats[2] else stats[1]

    @F.pandas_udf("long")
    def spot(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        value = ids.fillna(0).to_numpy(np.int64)
        at = np.where(known, np.searchsorted(limits, value, "right"), 0)
        opens = known & (at > 0)
        opens[opens] = limits[at[opens] - 1] == value[opens]
        return pd.Series(2 * at + opens)

    last = len(limits)
    is_first = F.col("doc_id").eqNullSafe(F.lit(first).cast("long"))
    own = F.struct(F.shiftright("_spot", 1).alias("range"), F.lit(False).alias("guest"))
    before = F.struct((F.shiftright("_spot", 1) - 1).alias("range"), F.lit(True).alias("guest"))
    around = F.struct(F.lit(last).cast("long").alias("range"), F.lit(True).alias("guest"))
    none = F.array().cast("array<struct<range:bigint,guest:boolean>>")
    places = F.concat(
        F.array(own),
        F.when(F.col("_spot").bitwiseAND(1) == 1, F.array(before)).otherwise(none),
        F.when(is_first, F.array(around)).otherwise(none),
    )
    dealt = rows.withColumn("_spot", spot("doc_id")).select("doc_id", "text", F.explode(places).alias("_place"))
    ordered = (
        dealt.select("doc_id", "text", "_place.range", "_place.guest")
        .repartitionById(last + 1, F.col("range").cast("int"))
        .sortWithinPartitions("range", "guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            n = table.num_rows
            for at in range(0, n - 1, 512):
                yield _compared(table.slice(at, min(513, n - at)), k, width)
            held = table.slice(n - 1, 1).to_batches()[0]

    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string,"
        " edited_fingerprint string, near_edited double, near_next double"
    )
    return ordered.mapInArrow(compare, schema)


def _compared(rows: pa.Table, k: int, width: int) -> pa.RecordBatch:
    """All rows but the last, each against the row that follows in its range."""
    texts, n = rows["text"].to_pylist(), rows.num_rows - 1
    ranges, guest = rows["range"].to_numpy(), rows["guest"].to_numpy()
    mine = np.flatnonzero(~guest[:n] & (ranges[:n] == ranges[1:]))
    edited = []
    for i in mine.tolist():
        half = len(texts[i]) // 2
        edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
    own = sketches(rows["text"].combine_chunks(), k, width)
    other = sketches(pa.array(edited, pa.string()), k, width)
    out = [
        rows["doc_id"].combine_chunks().take(pa.array(mine)),
        pa.array([len(texts[i]) for i in mine], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
        pa.array([write_sketch(own[i]) for i in mine], pa.string()),
        pa.array(map(write_sketch, other), pa.string()),
        pa.array([resemblance(own[i], e, k) for i, e in zip(mine, other)], pa.float64()),
        pa.array([resemblance(own[i], own[i + 1], k) for i in mine], pa.float64()),
    ]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays(out, names=names)
