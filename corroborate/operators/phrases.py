"""Word n-grams of normalised texts, hashed and sieved in the scan tasks.

Words stand between single spaces. Tasks hash the n-grams of whole slices at once and send each
distinct pair of topic and n-gram on once per ``FLUSH`` of them, packed, to the shard of its hash.
What the shards answer is a bit set of fixed size; only n-grams with a set bit are spelled out.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.llm import words as W

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARD_BYTES = 24 << 20  # of text whose n-grams one shard receives
FLUSH = 1 << 22
# 2^20 words of 64 bits, 8 MB, whatever the number of n-grams.
WORDS = 1 << 20


class _Grams:
    """N-grams of a slice: row, hash, and the bytes they span."""

    def __init__(self, texts: W.Texts, size: int):
        words = W.Words(texts, lower=False)
        self.row, self.key = W.shingles(words, size, whole_if_short=False)
        first = np.flatnonzero(words.first[words.doc + 1] - np.arange(len(words.doc)) >= size)
        self.start, self.end = words.start[first], words.end[first + size - 1]


def _bit(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (keys >> np.uint64(6)).astype(np.int64) & (WORDS - 1), np.uint64(1) << (keys & np.uint64(63))


def recurring(texts: DataFrame, size: int, min_topics: int) -> np.ndarray:
    """Bit set of the hashes of all n-grams (topic_id, text) that stand in ``min_topics`` topics."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    bounds = np.array([(s << 64) // shards for s in range(1, shards)], np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict = {}
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            keys, codes = (np.concatenate(x) for x in zip(*held))
            by = np.lexsort((codes, keys))
            keys, codes = keys[by], codes[by]
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (codes[1:] != codes[:-1])
            keys, codes = keys[fresh], codes[fresh]
            cuts = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
            topics, rows = list(names), []
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                own = slice(cuts[s], cuts[s + 1])
                used, which = np.unique(codes[own], return_inverse=True)
                steps = np.diff(keys[own], prepend=np.uint64(0))
                rows.append((s, [topics[i] for i in used.tolist()], zlib.compress(which.astype("<u4").tobytes(), 1), zlib.compress(steps.astype("<u8").tobytes(), 1)))
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.list_(pa.string()), pa.binary(), pa.binary()))]
            return pa.RecordBatch.from_arrays(arrays, names=["shard", "topics", "codes", "steps"])

        for batch in batches:
            mine = np.array([names.setdefault(t, len(names)) for t in batch.column(0).to_pylist()], np.int64)
            for at, slice_ in W.text_slices(batch.column(1)):
                grams = _Grams(slice_, size)
                held.append((grams.key, mine[grams.row + at]))
                count += len(grams.key)
                if count >= FLUSH:
                    yield flush()
                    held, count = [], 0
        if count:
            yield flush()

    def answer(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        names: dict = {}
        keys, codes = [], []
        for topics, which, steps in zip(group["topics"], group["codes"], group["steps"]):
            own = np.array([names.setdefault(t, len(names)) for t in topics], np.int64)
            codes.append(own[np.frombuffer(zlib.decompress(which), "<u4")])
            keys.append(np.cumsum(np.frombuffer(zlib.decompress(steps), "<u8"), dtype=np.uint64))
        keys, codes = np.concatenate(keys), np.concatenate(codes)
        by = np.lexsort((codes, keys))
        keys, codes = keys[by], codes[by]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        other = first.copy()
        other[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero(first)
        word, bit = _bit(keys[starts[np.add.reduceat(other.astype(np.int64), starts) >= min_topics]])
        by = np.argsort(word, kind="stable")
        word, at = np.unique(word[by], return_index=True)
        bits = np.bitwise_or.reduceat(bit[by], at) if len(at) else np.zeros(0, np.uint64)
        return pd.DataFrame({"word": word, "bits": bits.view(np.int64)})

    packed = texts.select(F.col("topic_id").cast("string"), "text").mapInArrow(ask, "shard int, topics array<string>, codes binary, steps binary")
    found = packed.groupBy("shard").applyInPandas(answer, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = found.toPandas()  # at most WORDS rows
    out = np.zeros(WORDS, np.uint64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def spelled(texts: DataFrame, size: int, wanted: np.ndarray) -> DataFrame:
    """topic_id, phrase: every n-gram whose hash has its bit set."""
    schema = texts.select("topic_id", F.col("text").alias("phrase")).schema

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, slice_ in W.text_slices(batch.column(1)):
                grams = _Grams(slice_, size)
                word, bit = _bit(grams.key)
                here = np.flatnonzero(wanted[word] & bit)
                raw = slice_.data.tobytes()
                phrases = [raw[a:b] for a, b in zip(grams.start[here].tolist(), grams.end[here].tolist())]
                topics = batch.column(0).take(pa.array(grams.row[here] + at))
                yield pa.RecordBatch.from_arrays([topics, pa.array(phrases, pa.binary()).cast(pa.string())], names=["topic_id", "phrase"])

    return texts.select("topic_id", "text").mapInArrow(spell, schema)
