"""Token ids in raw binary shards, found through a minimal perfect hash index.

A shard file holds a 16-byte head (magic, bytes per id, rows), the ids of its documents
in a row, and the limits of the rows as 64-bit numbers. Shards follow ascending doc_id.
The index maps a document key to (shard, row) in constant time: one lookup in a perfect
hash function, one comparison with the stored fingerprint of the key.
"""

from __future__ import annotations

import struct
import sys
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroborate.llm.encode import encoder
from corroborate.llm.words import mix
from corroborate.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAGIC = b"TOKSHRD1"
SHARD_BYTES = 32 << 20  # of text
KEYS_PER_INDEX_SHARD = 200_000
READ_TOKENS = 8 << 20  # stored ids that a task may read back
LEVELS = 40
HEAD = "<8sII"
HEAD_BYTES = struct.calcsize(HEAD)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bits, set where one key fell.

    A key's number is the rank of its bit. Keys that meet in every level, a few in
    2**LEVELS, are listed.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, parts = keys, [], []
        while len(left) and len(sizes) < LEVELS:
            size = -(-2 * len(left) // 64) * 64
            at = cls._place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
            sizes.append(size)
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, "<u8"), np.sort(left))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key; for a key never seen, some number or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + self._place(keys[todo], level, size)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = (self.before[at >> 6] + below)[hit]
            todo, base = todo[~hit], base + size
        if len(todo) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            same = self.rest[at] == keys[todo]
            out[todo[same]] = self.before[-1] + at[same]
        return out

    def pack(self) -> bytes:
        head = np.array([len(self.sizes), len(self.bits), len(self.rest), *self.sizes], "<i8")
        return head.tobytes() + self.bits.tobytes() + self.rest.astype("<u8").tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> PerfectHash:
        levels, words, rest = np.frombuffer(raw, "<i8", 3).tolist()
        sizes = np.frombuffer(raw, "<i8", levels, 24).tolist()
        at = 24 + 8 * levels
        return cls(sizes, np.frombuffer(raw, "<u8", words, at), np.frombuffer(raw, "<u8", rest, at + 8 * words))


def _key() -> Column:
    """64-bit key of doc_id. XXH64 of one long is a bijection, so keys never meet."""
    return F.when(F.col("doc_id").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("doc_id"))


def _mark() -> Column:
    """Fingerprint of the key, by another hash."""
    return F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(F.hash("doc_id"))


def _shard_path(path: str, shard: int) -> str:
    return f"{path}/payload/shard-{shard:08d}.ids"


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_bytes: int = 2) -> None:
    """Write payload shards, the shard table and the index of ``docs`` below ``path``.

    ``path`` must be new and shared by all executors. Null texts count as empty. Repeated
    doc_ids keep one row each, side by side; null doc_ids come first. A task that runs
    again writes the same bytes under a name of its own and then takes the final name.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    schema = "doc_id long, shard int, row int, n_tokens long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        files, base = pafs.FileSystem.from_uri(path)
        files.create_dir(f"{base}/payload")
        own = f"{_shard_path(base, shard)}.{uuid.uuid4().hex}"
        encode, limits = encoder(tokenizer, end_id, spaced=True), [np.zeros(1, np.int64)]
        done = rows = 0
        kind = {2: "<u2", 4: "<u4"}[id_bytes]
        with files.open_output_stream(own) as out:
            out.write(struct.pack(HEAD, MAGIC, id_bytes, 0))
            for batch in batches:
                for first, ids, ends in encode.batches(batch.column(1)):
                    out.write(ids.astype(kind).tobytes())
                    n = len(ends) - 1
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, n), pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(rows, rows + n, dtype=np.int32)), pa.array(np.diff(ends))],
                        names=["doc_id", "shard", "row", "n_tokens"],
                    )
                    limits.append(done + ends[1:])
                    done, rows = done + int(ends[-1]), rows + n
            out.write(np.concatenate(limits).astype("<i8").tobytes())
        files.move(own, _shard_path(base, shard))

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(shards, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    )
    rows = cut_lineage(ordered.mapInArrow(write, schema))
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    # One row a shard: a shard stands for some ten megabytes of text.
    base = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    totals.withColumn("base", F.coalesce(base, F.lit(0))).write.parquet(f"{path}/shards")
    _write_index(rows, path)


def _write_index(rows: DataFrame, path: str) -> None:
    keys = rows.groupBy("doc_id").agg(F.min("shard").alias("shard"), F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"))
    keys = cut_lineage(keys.select(_key().alias("key"), _mark().alias("mark"), "shard", "row", "copies"))
    parts = max(1, -(-keys.count() // KEYS_PER_INDEX_SHARD))

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        keys = group["key"].to_numpy().view(np.uint64)
        perfect = PerfectHash.build(keys)
        order = np.argsort(perfect.find(keys))
        entries = np.stack([group[c].to_numpy(np.int64)[order] for c in ("mark", "shard", "row", "copies")])
        return pd.DataFrame({"part": [key[0]], "parts": [parts], "hash": [perfect.pack()], "entries": [entries.astype("<i8").tobytes()]})

    # The high bits choose the index shard, the perfect hash mixes all of them.
    part = F.pmod(F.shiftrightunsigned("key", 40), F.lit(parts)).cast("int")
    built = keys.withColumn("part", part).groupBy("part").applyInPandas(build, "part int, parts int, hash binary, entries binary")
    built.write.parquet(f"{path}/index")


def find_rows(keys: DataFrame, path: str) -> DataFrame:
    """doc_id -> doc_id, shard, row for every stored row of it; unknown ids give nothing."""
    index = keys.sparkSession.read.parquet(f"{path}/index")
    parts = (index.agg(F.max("parts")).first()[0]) or 1
    schema = "doc_id long, shard int, row int"

    def look(wanted: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(wanted):
            return pd.DataFrame({"doc_id": pd.Series([], dtype="Int64"), "shard": pd.Series([], dtype="int32"), "row": pd.Series([], dtype="int32")})
        perfect = PerfectHash.unpack(shard["hash"][0])
        mark, at, row, copies = np.frombuffer(shard["entries"][0], "<i8").reshape(4, -1)
        slot = perfect.find(wanted["key"].to_numpy().view(np.uint64))
        known = (slot >= 0) & (slot < len(mark))
        known[known] = mark[slot[known]] == wanted["mark"].to_numpy()[known]
        slot = slot[known]
        n = copies[slot]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return pd.DataFrame(
            {"doc_id": wanted["doc_id"].astype("Int64")[known].repeat(n).to_numpy(), "shard": np.repeat(at[slot], n).astype(np.int32), "row": (np.repeat(row[slot], n) + step).astype(np.int32)}
        )

    wanted = keys.select("doc_id", _key().alias("key"), _mark().alias("mark"))
    wanted = wanted.withColumn("part", F.pmod(F.shiftrightunsigned("key", 40), F.lit(parts)).cast("int"))
    return wanted.groupBy("part").cogroup(index.groupBy("part")).applyInPandas(look, schema)


class _Shard:
    """An open shard file."""

    def __init__(self, path: str, shard: int, rows: int, tokens: int):
        files, base = pafs.FileSystem.from_uri(path)
        self.file = files.open_input_file(_shard_path(base, shard))
        magic, self.width, _ = struct.unpack(HEAD, self.file.read_at(HEAD_BYTES, 0))
        if magic != MAGIC:
            raise ValueError(f"shard {shard}: not a token shard")
        self.limits = np.frombuffer(self.file.read_at(8 * (rows + 1), HEAD_BYTES + self.width * tokens), "<i8")

    def ids(self, row: int) -> np.ndarray:
        begin, end = int(self.limits[row]), int(self.limits[row + 1])
        raw = self.file.read_at(self.width * (end - begin), HEAD_BYTES + self.width * begin)
        return np.frombuffer(raw, f"<u{self.width}")


def read_rows(found: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Read rows of the shards back: doc_id, start, n_tokens, ids_crc32, with the ids on request."""
    shards = found.sparkSession.read.parquet(f"{path}/shards")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, current = None, -1
        for batch in batches:
            cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            plain = {c: cols[c].to_numpy(zero_copy_only=False) for c in ("shard", "row", "rows", "tokens", "base")}
            n = batch.num_rows
            start, size, crc, texts = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64), []
            for i in range(n):
                if plain["shard"][i] != current:
                    current = int(plain["shard"][i])
                    shard = _Shard(path, current, int(plain["rows"][i]), int(plain["tokens"][i]))
                ids = shard.ids(int(plain["row"][i])).astype("<u4")
                start[i] = plain["base"][i] + shard.limits[plain["row"][i]]
                size[i], crc[i] = len(ids), zlib.crc32(ids.tobytes())
                if with_ids:
                    texts.append(ids.astype(np.int32))
            out = [cols["doc_id"], pa.array(start), pa.array(size), pa.array(crc)]
            if with_ids:
                out.append(pa.array(texts, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    # As many tasks as the stored ids ask for; the rows that name them are small.
    stored = shards.agg(F.sum("tokens")).first()[0] or 0
    parts = max(1, -(-stored // READ_TOKENS))
    placed = found.join(shards, "shard").repartition(parts, "shard").sortWithinPartitions("shard", "row")
    return placed.select("doc_id", "shard", "row", "rows", "tokens", "base").mapInArrow(read, schema)


def read_store(spark: SparkSession, path: str, keys: DataFrame, with_ids: bool = False) -> DataFrame:
    """Keyed access: the stored rows of every distinct doc_id in ``keys``."""
    return read_rows(find_rows(keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), path), path, with_ids)
