"""Product codes of integer vectors by ball k-means.

Every entry of a codebook has a ball: the vectors assigned to it, within a radius. Only
entries nearer than twice the radius can take vectors from it: its neighbours. A vector
closer to its entry than half the way to the nearest neighbour is in the stable core and is
not compared at all; the others lie in rings between the half-distances to the neighbours,
in ascending order, and are compared with the neighbours whose half-distance they pass.
All arithmetic is on integers, and the limits include ties, so the result is that of full
comparison.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.llm import vectors as V
from corroborate.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARTS = 16
ENTRIES = 64
HELD_VALUES = 1 << 20  # components of the vectors that are assigned at once


class Codebook:
    """Entries of one part position and what their balls say about neighbours."""

    def __init__(self, entries: np.ndarray, radius2: np.ndarray):
        self.entries = entries
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        self.neighbours, self.apart = [], []
        for j in range(len(entries)):
            # A vector of ball j is within radius; beyond twice that, no entry is as near.
            near = np.flatnonzero(apart[j] <= 4 * radius2[j]) if radius2[j] < 1 << 60 else np.arange(len(entries))
            near = near[near != j]
            near = near[np.argsort(apart[j][near], kind="stable")]
            self.neighbours.append(near)
            self.apart.append(apart[j][near])

    def assign(self, x: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Entry and squared distance of each row, and how many distances were computed."""
        own = x - self.entries[held]
        distance = (own * own).sum(axis=1)
        code, work = held.copy(), 0
        order = np.argsort(held, kind="stable")
        limits = np.searchsorted(held[order], np.arange(len(self.entries) + 1))
        for j in np.flatnonzero(np.diff(limits)).tolist():
            if not len(self.neighbours[j]):
                continue
            rows = order[limits[j] : limits[j + 1]]
            # The ring: how many neighbours are at most as far apart as twice the own distance.
            ring = np.searchsorted(self.apart[j], 4 * distance[rows], "right")
            top = 1
            while len(rows):
                live = ring > top // 2
                rows, ring = rows[live], ring[live]  # the first round leaves the stable core
                here = ring <= top
                if here.any():
                    work += self._compare(x, rows[here], self.neighbours[j][:top], code, distance)
                rows, ring = rows[~here], ring[~here]
                top *= 2
        return code, distance, work

    def _compare(self, x, rows, candidates, code, distance) -> int:
        e = self.entries[candidates]
        kind = V.exact_type(2 * int(max(np.abs(e).max(), np.abs(x[rows]).max())), e.shape[1])
        f, g = e.astype(kind), x[rows].astype(kind)
        d = (g * g).sum(axis=1)[:, None] - 2 * (g @ f.T) + (f * f).sum(axis=1)
        d = d.astype(np.int64)
        least = d.min(axis=1)
        # Of the candidates at the least distance the one with the lowest index.
        index = np.where(d == least[:, None], candidates, len(self.entries)).min(axis=1)
        better = (least < distance[rows]) | (least == distance[rows]) & (index < code[rows])
        code[rows[better]], distance[rows[better]] = index[better], least[better]
        return d.size


def _held(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """Batches joined to about ``HELD_VALUES`` components."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n * width >= HELD_VALUES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _assigned(state: DataFrame, books: list[Codebook], width: int, parts: int) -> DataFrame:
    """``state`` with new codes, the squared distance of each part and their sum."""
    inside = width // parts

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _held(batches, width):
            x = V.unpack(table["packed"].to_pylist(), width)
            codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(len(x), parts).astype(np.int64)
            made, distances = np.empty((len(x), parts), np.uint8), np.empty((len(x), parts), np.int64)
            for p, book in enumerate(books):
                code, distances[:, p], _ = book.assign(x[:, p * inside : (p + 1) * inside], codes[:, p])
                made[:, p] = code
            columns = [*(table[c].combine_chunks() for c in ("row", "packed")), pa.array([m.tobytes() for m in made], pa.binary()), pa.array(distances.sum(axis=1)), pa.array([d.tobytes() for d in distances], pa.binary())]
            out = pa.Table.from_arrays(columns, names=["row", "packed", "codes", "error", "distances"])
            yield from out.to_batches(max_chunksize=4096)

    schema = f"row {state.schema['row'].dataType.simpleString()}, packed binary, codes binary, error long, distances binary"
    return state.select("row", "packed", "codes").mapInArrow(assign, schema)


def _sums(state: DataFrame, width: int, parts: int, entries: int) -> list:
    """part, entry, n, far (largest squared distance), sums: one row for each used entry.

    Tasks add up what they hold; at most parts * entries rows leave a task and reach the driver.
    """
    inside = width // parts

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((parts, entries), np.int64)
        far = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, inside), np.int64)
        for table in _held(batches, width):
            x = V.unpack(table["packed"].to_pylist(), width)
            codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(len(x), parts).astype(np.int64)
            d = np.frombuffer(b"".join(table["distances"].to_pylist()), np.int64).reshape(len(x), parts)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                used, first = np.unique(codes[order, p], return_index=True)
                n[p, used] += np.diff(np.append(first, len(x)))
                sums[p, used] += np.add.reduceat(x[order, p * inside : (p + 1) * inside], first, axis=0)
                far[p, used] = np.maximum(far[p, used], np.maximum.reduceat(d[order, p], first))
        part, entry = np.nonzero(n)
        arrays = [pa.array(part), pa.array(entry), pa.array(n[part, entry]), pa.array(far[part, entry]), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["part", "entry", "n", "far", "sums"])

    found = state.select("packed", "codes", "distances").mapInArrow(add, "part long, entry long, n long, far long, sums array<long>")
    each = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(inside)]
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.max("far").alias("far"), *each).collect()


def learn_and_assign(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """Codes of all ``rows`` (vec_id, label, embedding) and the final entries (part, entry, component).

    The rows come back as vec_id, label, codes (a byte a part), error. Rows with an unusable
    vector are left out. Vectors that are shorter than the longest, or not a multiple of
    ``parts`` long, end in zeros. The first entries are the vectors with the smallest vec_id
    (null ones last; repeated ids by vector), fewer than ``entries`` if there are fewer rows;
    at most 256. Without rows there are no entries. Each round assigns all rows, then moves
    every used entry to the floor of its vectors' mean.
    """
    spark = rows.sparkSession
    kept = V.integer_vectors(rows.select("vec_id", "label", "embedding"))
    longest = kept.agg(F.max(F.size("embedding"))).first()[0]
    width = -(-max(longest or 0, 1) // parts) * parts
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    start = np.array([r.embedding + [0] * (width - len(r.embedding)) for r in first], np.int64).reshape(len(first), parts, width // parts)
    books = start.transpose(1, 0, 2).copy()
    row_type = f"struct<vec_id:{kept.schema['vec_id'].dataType.simpleString()},label:{kept.schema['label'].dataType.simpleString()}>"
    if not first:
        return spark.createDataFrame([], f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}, codes binary, error long"), books

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [batch.column(0), pa.array(V.pack(V.matrix(batch.column(1), width)), pa.binary()), pa.array([bytes(parts)] * batch.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "packed", "codes"])

    state = kept.select(F.struct("vec_id", "label").alias("row"), "embedding").mapInArrow(packed, f"row {row_type}, packed binary, codes binary")
    radius2 = np.full((parts, len(first)), 1 << 60, np.int64)  # nothing is known before the first round
    for _ in range(rounds):
        state = cut_lineage(_assigned(state, [Codebook(b, r) for b, r in zip(books, radius2)], width, parts))
        far = np.zeros_like(radius2)
        for s in _sums(state, width, parts, len(first)):
            new = np.array([s[f"s{i}"] // s["n"] for i in range(width // parts)], np.int64)
            moved = float(((new - books[s["part"], s["entry"]]) ** 2).sum()) ** 0.5
            books[s["part"], s["entry"]] = new
            # Members lie within the old radius and the way that the entry moved.
            far[s["part"], s["entry"]] = min(int((float(s["far"]) ** 0.5 + moved) ** 2 * (1 + 1e-9)) + 1, 1 << 60)
        radius2 = far
    state = _assigned(state, [Codebook(b, r) for b, r in zip(books, radius2)], width, parts)
    return state.select("row.vec_id", "row.label", "codes", "error"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
