"""Best-fit packing by the sum-of-squares rule.

Each document goes where the sum over gaps of (open bins with that gap) squared
becomes smallest, so no gap piles up. Groups of pieces are packed in parallel; their
bins that stay open are then packed against each other as if they were documents,
in rounds over ever fewer groups.
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

from corroborate.llm.encode import encoder
from corroborate.llm.memory import frugal
from corroborate.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECES_PER_GROUP = 10_000  # what one group packs in about a second
FAN_IN = 16


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Documents as token pieces of at most ``capacity``: doc_id, piece, start, length, ids_crc32.

    A null or empty text is its end id alone. Columns other than ``doc_id`` and ``text``
    are ignored; equal rows give equal pieces. ``with_ids`` adds the ids themselves.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, end_id, spaced=False)
        for batch in batches:
            doc_ids = batch.column(0)
            for first, ids, limits in encode.batches(batch.column(1)):
                total = np.diff(limits)
                n = -(-total // capacity)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, total[row] - start)
                begin = limits[row] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                spans = zip((4 * begin).tolist(), (4 * (begin + length)).tolist())
                crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in spans), np.int64, len(row))
                out = [doc_ids.take(pa.array(first + row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc)]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(np.append(limits[:-1][row] + start, limits[-1]).astype(np.int32), pa.array(ids.astype(np.int32))))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(out, names=names[: len(out)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, offset in it, level of each bin) for items in the given order."""
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    never = np.int64(1) << 40
    closed = np.where(np.arange(capacity + 1) == 0, 0, never)
    level: list[int] = []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        # Change of the sum: bins move from level h to h + size; level 0 is a new bin.
        reach = capacity - size
        change = count[size:] - count[: reach + 1]
        change *= 2
        change += closed[: reach + 1]
        change[1:] += 2
        if reach:
            change[reach] -= 1
            change[0] += 1
        at = reach - int(np.argmin(change[::-1]))
        if at:
            b = open_bins[at].pop()
            count[at] -= 1
            if not count[at]:
                closed[at] = never
        else:
            b = len(level)
            level.append(0)
        where[i], offset[i] = b, at
        at += size
        level[b] = at
        if at < capacity:
            open_bins[at].append(b)
            count[at] += 1
            closed[at] = 0
    return where, offset, np.array(level, np.int64)


def _pack_groups(items: DataFrame, groups: int, capacity: int, level: int) -> DataFrame:
    """item, size -> item, bin, offset, filled; items are dealt to groups by their hash."""
    schema = "item long, bin long, offset long, filled long"

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "item"], ascending=[False, True], kind="stable")
        where, offset, filled = sum_of_squares(group["size"].to_numpy(), capacity)
        name = (level << 56) + (int(key[0]) << 24) + where
        return pd.DataFrame({"item": group["item"].to_numpy(), "bin": name, "offset": offset, "filled": filled[where]})

    dealt = items.withColumn("_group", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int"))
    return dealt.groupBy("_group").applyInPandas(pack, schema)


def pack_items(items: DataFrame, capacity: int) -> DataFrame:
    """item long (distinct), size long (1 to ``capacity``) -> item, bin, offset.

    A group holds about ``PIECES_PER_GROUP`` items whatever their sizes. Bins still open
    after a round are the items of the next one; rounds end when one group held all of
    them, or when a round closes hardly any more.
    """
    groups = -(-items.count() // PIECES_PER_GROUP) or 1
    placed = cut_lineage(_pack_groups(items, groups, capacity, 1))
    left, level = placed, 1
    while groups > 1:
        open_bins = left.filter(F.col("filled") < capacity).groupBy("bin").agg(F.first("filled").alias("size"))
        open_bins = cut_lineage(open_bins.withColumnRenamed("bin", "item"))
        n = open_bins.count()
        groups = max(-(-n // PIECES_PER_GROUP), -(-groups // FAN_IN), 1)
        level += 1
        left = cut_lineage(_pack_groups(open_bins, groups, capacity, level))
        moved = left.select(F.col("item").alias("bin"), F.col("bin").alias("_bin"), F.col("offset").alias("_offset"))
        placed = placed.join(moved, "bin", "left").select(
            "item",
            F.coalesce("_bin", "bin").alias("bin"),
            (F.col("offset") + F.coalesce("_offset", F.lit(0))).alias("offset"),
        )
        if left.select("bin").distinct().count() > 0.99 * n:
            break
    return placed.select("item", "bin", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Place every token piece of every document in a sequence of ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Repeated rows
    are packed once each, null texts as their end id, an empty table gives no rows.
    """
    pieces = token_pieces(docs, tokenizer, end_id, capacity).withColumn("item", F.monotonically_increasing_id())
    pieces = cut_lineage(pieces)
    whole = F.col("length") == capacity
    loose = pieces.filter(~whole).select("item", F.col("length").alias("size"))
    placed = pack_items(loose, capacity)
    cut = pieces.filter(whole).withColumns({"sequence_id": F.col("item"), "offset": F.lit(0).cast("long")})
    rest = pieces.filter(~whole).join(placed.withColumnRenamed("bin", "sequence_id"), "item")
    return cut.unionByName(rest).drop("item")


def packed_sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """The sequences themselves: sequence_id, ids array<int> (at most ``capacity`` long)."""
    pieces = token_pieces(docs, tokenizer, end_id, capacity, with_ids=True).select("doc_id", "piece", "ids_crc32", "ids")
    pieces = pieces.dropDuplicates(["doc_id", "piece", "ids_crc32"])
    keys = [F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}")) for c in ("doc_id", "piece", "ids_crc32")]
    both = placed.alias("p").join(pieces.alias("q"), keys[0] & keys[1] & keys[2]).select("sequence_id", "offset", "ids")
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return both.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda s: s["ids"])).alias("ids"))
