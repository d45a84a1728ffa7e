"""Language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams, most frequent first. A
document goes to the language whose profile is least out of place: for each of its own
grams the difference of the two ranks, or the profile's length where the gram is missing.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corroborate.llm.memory import frugal
from corroborate.llm.words import mix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_N = 3
PROFILE_SIZE = 300
UNKNOWN = "und"
SLICE_CHARS = 1 << 18
_GRAM_BITS = np.uint64(44)


def _letters() -> np.ndarray:
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def _text_slices(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, lower-cased texts) of whole documents, null as empty."""
    first, held, size = 0, [], 0
    for i, text in enumerate(column):
        held.append((text.as_py() or "").lower())
        size += len(held[-1])
        if size >= SLICE_CHARS:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def gram_counts(texts: list[str], letters: np.ndarray, max_n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, gram, count) ordered by document and gram, for at most 2**20 texts.

    Grams run within words; a blank stands for either end of a word.
    """
    points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    limits = np.cumsum([len(t) + 2 for t in texts])
    doc = np.repeat(np.arange(len(texts)), np.diff(limits, prepend=0))
    seq = np.where(letters[points], points, 0).astype(np.uint64)
    keep = seq > 0
    keep[1:] |= seq[:-1] > 0
    if len(limits):
        keep[np.concatenate([[0], limits[:-1]])] = True
    seq, doc = seq[keep], doc[keep]
    code, crosses, keys = seq.copy(), np.zeros(len(seq), bool), []
    for n in range(1, max_n + 1):
        if n > 1:
            code = code[:-1] * np.uint64(0x9E3779B97F4A7C15) + seq[n - 1 :]
            crosses = crosses[:-1] | (doc[n - 2 : -1] != doc[n - 1 :])
        if n > 2:
            crosses |= seq[n - 2 : -1] == 0
        good = ~crosses & ((seq[: len(code)] > 0) | (n > 1))
        gram = mix(code[good] + np.uint64(n << 56)) >> (np.uint64(64) - _GRAM_BITS)
        keys.append(doc[: len(code)][good].astype(np.uint64) << _GRAM_BITS | gram)
    flat = np.sort(np.concatenate(keys))
    fresh = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    count = np.diff(np.append(fresh, len(flat)))
    flat = flat[fresh]
    return (flat >> _GRAM_BITS).astype(np.int64), flat & ((np.uint64(1) << _GRAM_BITS) - np.uint64(1)), count


def learn_profiles(docs: DataFrame, max_n: int = MAX_N, size: int = PROFILE_SIZE) -> DataFrame:
    """lang, gram, rank (from 0) from all rows with text and lang; ties go by gram.

    The result has ``size`` rows a language at most. Null texts and languages teach nothing.
    """

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            number = langs.indices.to_numpy(zero_copy_only=False).astype(np.uint64)
            keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for first, texts in _text_slices(batch.column(0)):
                doc, gram, n = gram_counts(texts, letters, max_n)
                keys.append(number[first + doc] << _GRAM_BITS | gram)
                counts.append(n)
            key, which = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(which, np.concatenate(counts), len(key)).astype(np.int64)
            gram = (key & ((np.uint64(1) << _GRAM_BITS) - np.uint64(1))).astype(np.int64)
            lang = langs.dictionary.take(pa.array((key >> _GRAM_BITS).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([lang, pa.array(gram), pa.array(total)], names=["lang", "gram", "n"])

    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", F.col("lang").cast("string"))
    counts = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank - 1).filter(F.col("rank") < size).select("lang", "gram", "rank")


def identify(docs: DataFrame, profiles: pd.DataFrame, max_n: int = MAX_N, size: int = PROFILE_SIZE) -> DataFrame:
    """Add lang_pred and score to ``docs`` (columns of these names are replaced).

    ``profiles`` is the collected result of learn_profiles: ``size`` rows a language. The
    score is one minus the share of the largest possible distance. A text that is null, or
    without letters, is ``und`` with score 0, as is every text when nothing was learned.
    Equal distances go to the first language by name.
    """
    names = sorted(profiles["lang"].unique())
    tables = []
    for name in names:
        one = profiles[profiles["lang"] == name].sort_values("gram")
        tables.append((one["gram"].to_numpy(np.int64), one["rank"].to_numpy(np.int64)))

    @frugal
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters = _letters()
        for batch in batches:
            pred, score = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
            for first, texts in _text_slices(pa.array(batch, pa.string())):
                doc, gram, n = gram_counts(texts, letters, max_n)
                order = np.lexsort((gram, -n, doc))
                doc, gram = doc[order], gram[order].astype(np.int64)
                begin = np.searchsorted(doc, np.arange(len(texts)))
                rank = np.arange(len(doc)) - begin[doc]
                doc, gram, rank = doc[rank < size], gram[rank < size], rank[rank < size]
                grams = np.bincount(doc, minlength=len(texts))
                if not tables or not len(doc):
                    continue
                distance = []
                for known, ranks in tables:
                    at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
                    off = np.where(known[at] == gram, np.abs(ranks[at] - rank), size)
                    distance.append(np.bincount(doc, off, len(texts)))
                best = np.argmin(distance, axis=0)
                here = np.flatnonzero(grams)
                pred[first + here] = np.array(names, object)[best[here]]
                score[first + here] = 1 - np.min(distance, axis=0)[here] / (size * grams[here])
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    spot = F.pandas_udf(place, "lang_pred string, score double")
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "_spot")]
    placed = docs.select(*[docs[f"`{c}`"] for c in kept], spot(docs["text"]).alias("_spot"))
    return placed.select(*[F.col(f"`{c}`") for c in kept], "_spot.lang_pred", "_spot.score")
