"""Hard negatives by rotated one-bit codes with exact intervals.

A vector is rotated and coded by the signs of its components; its alignment, the share of
the vector that lies along the code, is stored. What the code misses is rotated and coded
again, a few times. An inner product with an anchor is then a sum of popcounts of the codes
with the bit planes of the rotated anchor, within an interval: by Cauchy-Schwarz, what is
left of the vector adds at most its length times that of the anchor, and rounding the anchor
at most the alignment times the rounding's length. Rows whose interval cannot reach what an
anchor still wants are left out; all others are scored in integers. No row is lost.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corroborate.llm import vectors as V
from corroborate.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEVELS = 3
PLANES = 6
SLOT_VALUES = 1 << 19  # components of the vectors that one slot of rows holds
TILE = 64  # anchors that are compared with a slot at once
NO_ID = np.iinfo(np.int64).max
MARGIN = 1e-9  # of the largest possible product, for rounding in floating point


def rotations(width: int, levels: int = LEVELS) -> list[np.ndarray]:
    """Fixed orthogonal matrices, one a level."""
    made = np.random.default_rng(20).standard_normal((levels, width, width))
    return [np.linalg.qr(m)[0] for m in made]


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits of each row as 64-bit words."""
    packed = np.packbits(bits, axis=-1)
    short = -packed.shape[-1] % 8
    return np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, short)]).view(np.uint64)


class Codes:
    """Codes of vectors: for each level the sign words and how far the vector goes along the code."""

    def __init__(self, vectors: np.ndarray, turns: list[np.ndarray]):
        rest = vectors.astype(np.float64)
        n, width = rest.shape
        self.words, self.along, self.left = [], [], []
        for turn in turns:
            turned = rest @ turn
            positive = turned >= 0
            along = np.abs(turned).sum(axis=1) / np.sqrt(width)
            signs = np.where(positive, 1.0, -1.0) / np.sqrt(width)
            rest = rest - (along[:, None] * signs) @ turn.T
            self.words.append(_words(positive)), self.along.append(along)
            self.left.append(np.sqrt((rest * rest).sum(axis=1)))


class Asked:
    """Anchors, rotated and rounded to bit planes, level by level."""

    def __init__(self, vectors: np.ndarray, turns: list[np.ndarray], planes: int = PLANES):
        v = vectors.astype(np.float64)
        self.length = np.sqrt((v * v).sum(axis=1))
        self.planes, self.low, self.step, self.total, self.lost = [], [], [], [], []
        for turn in turns:
            turned = v @ turn
            low = turned.min(axis=1)
            step = np.maximum((turned.max(axis=1) - low) / ((1 << planes) - 1), 1e-12)
            whole = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
            gap = turned - (low[:, None] + step[:, None] * whole)
            self.planes.append([_words((whole >> p & 1).astype(bool)) for p in range(planes)])
            self.low.append(low), self.step.append(step), self.total.append(whole.sum(axis=1))
            self.lost.append(np.sqrt((gap * gap).sum(axis=1)))

    def along(self, level: int, a: np.ndarray, codes: Codes, b: np.ndarray, width: int) -> np.ndarray:
        """Inner product of anchors ``a`` with the unit codes of rows ``b`` (index arrays that broadcast)."""
        words = codes.words[level][b]
        ones = np.bitwise_count(words).sum(axis=-1, dtype=np.int32)
        dot = np.zeros(np.broadcast_shapes(np.shape(a), np.shape(b)), np.int32)
        for p, plane in enumerate(self.planes[level]):
            dot += np.bitwise_count(plane[a] & words).sum(axis=-1, dtype=np.int32) << p
        # Signs are 2 * bit - 1.
        return (self.low[level][a] * (2 * ones - width) + self.step[level][a] * (2 * dot - self.total[level][a])) / np.sqrt(width)


def surviving(asked: Asked, codes: Codes, width: int, anchors: np.ndarray, rows: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor, row) whose product may lie within ``least`` and ``most`` of the anchor."""
    a, b = anchors[:, None], rows[None, :]
    estimate = wrong = np.zeros((len(anchors), len(rows)))
    low, high = least[:, None], most[:, None]
    for level in range(len(codes.words)):
        along = codes.along[level][b]
        estimate = estimate + along * asked.along(level, a, codes, b, width)
        wrong = wrong + along * asked.lost[level][a]
        first = codes.along[0][b] + codes.left[0][b]
        reach = wrong + codes.left[level][b] * asked.length[a] + MARGIN * (1 + first * asked.length[a])
        kept = (estimate + reach >= low) & (estimate - reach <= high)
        if a.ndim == 2:
            i, j = np.nonzero(kept)
            a, b, low, high = anchors[i], rows[j], least[i], most[i]
            estimate, wrong = estimate[i, j], wrong[i, j]
        else:
            a, b, low, high, estimate, wrong = a[kept], b[kept], low[kept], high[kept], estimate[kept], wrong[kept]
    return a, b


class _Slot:
    """Rows of one slot, ordered by label, and their codes."""

    def __init__(self, parts: list[pa.RecordBatch], width: int, turns: list[np.ndarray]):
        table = pa.Table.from_batches(parts)
        label = table["label"].to_numpy()
        order = np.argsort(label, kind="stable")
        self.label = label[order]
        self.row = table["row"].to_numpy()[order]
        self.vec_id = table["vec_id"].fill_null(NO_ID).to_numpy()[order]
        self.vector = V.unpack(table["packed"].to_pylist(), width)[order]
        self.codes = Codes(self.vector, turns)
        self.largest = int(np.abs(self.vector).max()) if self.vector.size else 0

    def scores(self, vectors: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Integer products of the pairs."""
        largest = max(self.largest, int(np.abs(vectors).max()) if vectors.size else 0)
        kind = V.exact_type(largest, vectors.shape[1])
        out = np.empty(len(a), np.int64)
        for i in range(0, len(a), 1 << 16):
            part = slice(i, i + (1 << 16))
            out[part] = np.einsum("ij,ij->i", vectors[a[part]].astype(kind), self.vector[b[part]].astype(kind)).astype(np.int64)
        return out

    def best(self, score: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        """Positions of the first ``n`` by score, then vec_id, then row."""
        return np.lexsort((self.row[b], self.vec_id[b], -score))[:n]


def _groups(a: np.ndarray, n: int) -> np.ndarray:
    """Limits of each anchor's pairs, which are in order."""
    return np.searchsorted(a, np.arange(n + 1))


def _nearest(slot: _Slot, batch: pa.RecordBatch, width: int, turns: list[np.ndarray], n: int) -> pa.RecordBatch:
    """The best ``n`` rows of each anchor's label, the anchor itself left out."""
    label, own = batch["label"].to_numpy(), batch["row"].to_numpy()
    vectors = V.unpack(batch["packed"].to_pylist(), width)
    asked = Asked(vectors, turns)
    found: list[tuple[int, int, int]] = []
    for value in np.unique(label).tolist():
        rows = np.arange(*np.searchsorted(slot.label, [value, value + 1]).tolist())
        anchors = np.flatnonzero(label == value)
        for at in range(0, len(anchors), TILE) if len(rows) else ():
            tile = anchors[at : at + TILE]
            # The first rows give every anchor a bound that the rest must reach.
            head, rest = rows[: 16 * n], rows[16 * n :]
            a, b = np.repeat(tile, len(head)), np.tile(head, len(tile))
            apart = own[a] != slot.row[b]
            a, b = a[apart], b[apart]
            score = slot.scores(vectors, a, b)
            least = np.full(len(tile), -np.inf)
            for k, i in enumerate(tile.tolist()):
                mine = np.sort(score[a == i])
                least[k] = mine[-n] if len(mine) >= n else -np.inf
            more, others = surviving(asked, slot.codes, width, tile, rest, least, np.full(len(tile), np.inf))
            apart = own[more] != slot.row[others]
            more, others = more[apart], others[apart]
            a, b = np.concatenate([a, more]), np.concatenate([b, others])
            score = np.concatenate([score, slot.scores(vectors, more, others)])
            order = np.argsort(a, kind="stable")
            a, b, score = a[order], b[order], score[order]
            limits = np.searchsorted(a, np.append(tile, len(label)))
            for k, i in enumerate(tile.tolist()):
                part = slice(limits[k], limits[k + 1])
                found += [(i, int(b[part][j]), int(score[part][j])) for j in slot.best(score[part], b[part], n).tolist()]
    i, b, s = (np.array(c, np.int64) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    arrays = [pa.array(own[i]), _ids(slot.vec_id[b]), pa.array(slot.row[b]), pa.array(s)]
    return pa.RecordBatch.from_arrays(arrays, names=["anchor", "id", "row", "score"])


def _ids(values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=values == NO_ID)


def _between(slot: _Slot, batch: pa.RecordBatch, width: int, turns: list[np.ndarray], n: int, low: int, high: int) -> pa.RecordBatch:
    """For every anchor and positive the best ``n`` rows of other labels within the positive's band."""
    label, own = batch["label"].to_numpy(), batch["row"].to_numpy()
    vectors = V.unpack(batch["packed"].to_pylist(), width)
    asked = Asked(vectors, turns)
    positives = [np.array(p, np.int64) for p in batch["positives"].to_pylist()]
    found: list[tuple[int, int, int, int]] = []
    every = np.arange(len(slot.row))
    head, rest = every[:: max(1, len(every) // 512)], None
    rest = np.setdiff1d(every, head)
    for at in range(0, len(label), TILE):
        tile = np.arange(at, min(at + TILE, len(label)))
        # low * p <= 100 * s <= high * p, in whole scores
        bands = [(-(-low * positives[i] // 100), high * positives[i] // 100) for i in tile.tolist()]
        a, b = np.repeat(tile, len(head)), np.tile(head, len(tile))
        other = label[a] != slot.label[b]
        a, b = a[other], b[other]
        score = slot.scores(vectors, a, b)
        limits = np.searchsorted(a, np.append(tile, len(label)))
        least, most = np.full(len(tile), np.inf), np.full(len(tile), -np.inf)
        for k, (floor, cap) in enumerate(bands):
            mine = np.sort(score[limits[k] : limits[k + 1]])
            for f, c in zip(floor.tolist(), cap.tolist()):
                if f > c:
                    continue
                below = int(np.searchsorted(mine, c, "right"))
                least[k] = min(least[k], max(f, mine[below - n]) if below >= n else f)
                most[k] = max(most[k], c)
        open_ = least <= most
        more, others = surviving(asked, slot.codes, width, tile[open_], rest, least[open_], most[open_]) if open_.any() else (np.zeros(0, np.int64),) * 2
        other = label[more] != slot.label[others]
        more, others = more[other], others[other]
        a, b = np.concatenate([a, more]), np.concatenate([b, others])
        score = np.concatenate([score, slot.scores(vectors, more, others)])
        order = np.lexsort((slot.row[b], slot.vec_id[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        limits = np.searchsorted(a, np.append(tile, len(label)))
        for k, (floor, cap) in enumerate(bands):
            s, r = score[limits[k] : limits[k + 1]], b[limits[k] : limits[k + 1]]
            for p, (f, c) in enumerate(zip(floor.tolist(), cap.tolist())):
                first, last = np.searchsorted(-s, [-c, -f + 1]).tolist()
                found += [(int(tile[k]), p, int(r[j]), int(s[j])) for j in range(first, min(last, first + n))]
    i, p, b, s = (np.array(c, np.int64) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
    arrays = [pa.array(own[i]), pa.array(p), _ids(slot.vec_id[b]), pa.array(slot.row[b]), pa.array(s)]
    return pa.RecordBatch.from_arrays(arrays, names=["anchor", "positive", "id", "row", "score"])


def _meet(rows: DataFrame, anchors: DataFrame, slots: int, width: int, meet, schema: str) -> DataFrame:
    """``meet(slot, anchors)`` of every slot of rows with every batch of anchors.

    A slot is one bounded block of rows; the anchors, the stated query set, go to each slot
    and stream past it, so a task holds one slot and one batch.
    """
    turns = rotations(width)
    columns = ["slot", "asks", "row", "vec_id", "label", "packed", "positives"]
    kept = rows.select("slot", F.lit(False).alias("asks"), "row", "vec_id", "label", "packed", F.lit(None).cast("array<long>").alias("positives"))
    asking = anchors.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).withColumn("asks", F.lit(True))
    both = kept.unionByName(asking.select(*columns)).repartition(slots, "slot").sortWithinPartitions("slot", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, slot = None, [], None
        for batch in batches:
            number, asks = batch["slot"].to_numpy(), batch["asks"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(number)]):
                if hi == lo:
                    continue
                if number[lo] != current:
                    current, parts, slot = number[lo], [], None
                part = batch.slice(lo, hi - lo)
                if not asks[lo]:
                    parts.append(part)
                elif parts:
                    slot = slot or _Slot(parts, width, turns)
                    yield meet(slot, part, width, turns)

    return both.mapInArrow(run, schema)


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label and embedding. Anchors are the rows whose vec_id ``every``
    divides. Scores are inner products of floor(256 * x). A row without a label or usable
    vector takes no part; one without vec_id is never an anchor and comes last among ties.
    Vectors of other length are compared as if they ended in zeros. Rows that repeat are rows
    of their own: each copy of an anchor is asked for itself, and finds the others as rows of its label.
    Without rows, anchors, positives or rows in a band there is no output for them.
    """
    kept = V.integer_vectors(rows.filter(F.col("label").isNotNull()).select("vec_id", "label", "embedding"))
    count, longest = kept.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    width = max(longest or 0, 1)
    slots = max(1, -(-count * width // SLOT_VALUES))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = pa.array(V.pack(V.matrix(batch.column(3), width)), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], vectors], names=["row", "vec_id", "label", "packed"])

    named = kept.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    state = named.mapInArrow(packed, "row long, vec_id long, label long, packed binary")
    state = cut_lineage(state.withColumn("slot", F.pmod(F.xxhash64("row"), F.lit(slots)).cast("int")))
    anchors = state.filter(F.col("vec_id") % every == 0).drop("slot")
    asking = anchors.withColumn("positives", F.lit(None).cast("array<long>"))

    def first(slot, batch, width, turns):
        return _nearest(slot, batch, width, turns, positives)

    near = _meet(state, asking, slots, width, first, "anchor long, id long, row long, score long")
    best = Window.partitionBy("anchor").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    near = cut_lineage(near.withColumn("positive", F.row_number().over(best) - 1).filter(F.col("positive") < positives))
    # At most ``positives`` scores an anchor.
    wanted = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("positive", "score"))).alias("p"))
    asking = anchors.join(wanted.select(F.col("anchor").alias("row"), F.col("p.score").alias("positives")), "row")

    def second(slot, batch, width, turns):
        return _between(slot, batch, width, turns, negatives, low, high)

    met = _meet(state, asking, slots, width, second, "anchor long, positive long, id long, row long, score long")
    best = Window.partitionBy("anchor", "positive").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    met = met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    of_anchor = near.join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    pairs = of_anchor.select("anchor", "anchor_id", "positive", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    met = met.select("anchor", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(met, ["anchor", "positive"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
