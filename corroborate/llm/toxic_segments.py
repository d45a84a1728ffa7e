"""Toxicity by maximum-scoring segments.

Token weights are log-odds of toxic against other labelled text, smoothed by a Dirichlet
prior and lowered to the end of their confidence interval; every other token costs a
little. All maximal segments of a document are found in one pass, their scores are judged
against the extreme-value law of chance segments, and the evidence of all of them becomes
one probability.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.llm import words as W
from corroborate.llm.memory import frugal

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PRIOR = 0.5
BACKGROUND = 1000.0
LOWER = 2.58  # standard errors below the estimate
MARGIN = 1.0  # log-odds that a token must surely exceed; common words never do
TOKEN_COST = 0.2
# Tokens are runs of ASCII letters and digits and of all characters beyond ASCII, and
# runs of other marks: how a text shouts counts as well as what it says.
_KIND = np.full(256, 2, np.uint8)
_KIND[np.r_[0x30:0x3A, 0x41:0x5B, 0x61:0x7B, 0x80:0x100]] = 1
_KIND[W.SPACES] = 0


class Tokens(W.Words):
    """Word and mark tokens of a slice; ``before`` is the hash of the token before, 0 at the start."""

    def __init__(self, texts: W.Texts):
        n = len(texts.data)
        kind = np.zeros(n + 2, np.uint8)
        kind[1:-1] = _KIND[texts.data]
        change = kind[1:] != kind[:-1]
        change[texts.limits] = True
        at = np.flatnonzero(change)
        run = kind[1:][at[:-1]] > 0 if len(at) else np.zeros(0, bool)
        self.start, self.end = at[:-1][run], at[1:][run]
        self._file(texts)
        self.hash = W.hash_spans(texts, self.start, self.end, lower=True)
        self.before = np.zeros(len(self.hash), np.uint64)
        self.before[1:] = np.where(self.doc[1:] == self.doc[:-1], self.hash[:-1], np.uint64(0))


@dataclass
class Model:
    """Tokens with positive weight, by ascending hash, and the law of chance segments."""

    tokens: np.ndarray
    weights: np.ndarray
    base_rate: float
    rate: float  # lambda
    scale: float  # K
    cost: float = TOKEN_COST


def learn(docs: DataFrame, sample: DataFrame, base_rate: float | None = None) -> Model:
    """Weights from the texts of the sampled rows; ``sample`` (doc_id, label) is small and bounded.

    A token counts once for each token before it, so that copies of one text, which repeat
    tokens together with their neighbours, weigh no more than one. ``base_rate`` is the share
    of toxic rows, that of the sample unless given.
    """

    @frugal
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
            found = []
            for first, texts in W.text_slices(batch.column(0)):
                w = Tokens(texts)
                found.append(np.stack([w.hash, w.before, label[first + w.doc]]))
            rows = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.uint64)
            order = np.lexsort(rows)
            rows = rows[:, order]
            fresh = np.ones(rows.shape[1], bool)
            fresh[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
            token, before, kind = rows[:, fresh].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(before), pa.array(kind)], names=["token", "before", "label"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = texts.filter(F.col("text").isNotNull()).select("text", "label").mapInArrow(contexts, "token long, before long, label long")
    once = rows.distinct().groupBy("token").agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b"))
    once = once.persist()
    sums = once.agg(F.sum("a"), F.sum("b")).first()
    # Tokens without a toxic context never get a positive weight.
    counts = once.filter(F.col("a") > 1).toPandas()
    once.unpersist()
    toxic = sample.agg(F.avg("label")).first()[0] if base_rate is None else base_rate
    return fit(counts["token"].to_numpy(np.int64).view(np.uint64), counts["a"].to_numpy(float), counts["b"].to_numpy(float), float(sums[0] or 0), float(sums[1] or 0), float(toxic or 0))


def fit(token: np.ndarray, a: np.ndarray, b: np.ndarray, all_a: float, all_b: float, base_rate: float) -> Model:
    """Model from context counts of tokens in toxic (a) and other (b) text."""
    share = (a + b) / max(all_a + all_b, 1.0)
    alpha = PRIOR + BACKGROUND * share
    total = BACKGROUND + PRIOR * max(len(token), 1)
    odds = np.log((a + alpha) / (all_a + total - a - alpha)) - np.log((b + alpha) / (all_b + total - b - alpha))
    weight = odds - LOWER * np.sqrt(1 / (a + alpha) + 1 / (b + alpha)) - MARGIN
    keep = weight > 0
    token, weight, chance = token[keep], weight[keep], ((b + alpha) / (all_b + total))[keep]
    order = np.argsort(token)
    token, weight, chance = token[order], weight[order], chance[order]
    other = 1.0 - min(chance.sum(), 0.5)
    # The rate solves E[exp(rate * score)] = 1 for tokens of other text.
    low, high = 1e-6, 1.0
    excess = lambda r: (chance * np.exp(r * weight)).sum() + other * math.exp(-r * TOKEN_COST) - 1
    while len(token) and excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    scale = (1 - math.exp(-low * TOKEN_COST)) ** 2
    return Model(token, weight, base_rate, low, scale)


def maximal_segments(position: list[int], weight: list[float], cost: float) -> list[tuple[int, int, float]]:
    """All maximal segments (first token, last token, score), left to right, in linear time.

    ``position`` lists the tokens of positive weight; the tokens between cost ``cost`` each.
    """
    left, right, first, last, link = [], [], [], [], []
    total, before = 0.0, -1
    for p, w in zip(position, weight):
        total -= cost * (p - before - 1)
        l, r, a = total, total + w, p
        total, before = r, p
        k = len(left) - 1
        while True:
            while k >= 0 and left[k] >= l:
                k = link[k]
            if k < 0 or right[k] >= r:
                break
            # Extend to the left over segment k, which then swallows all after it.
            l, a = left[k], first[k]
            del left[k:], right[k:], first[k:], last[k:], link[k:]
            k = len(left) - 1
        left.append(l), right.append(r), first.append(a), last.append(p), link.append(k)
    return [(a, b, r - l) for a, b, l, r in zip(first, last, left, right)]


def chance(scores: list[float], n_tokens: int, model: Model) -> float:
    """Expected number of chance findings as good as the best, or the best few, segments."""
    excess = sorted((model.rate * s - math.log(max(model.scale * n_tokens, 1e-9)) for s in scores), reverse=True)
    best, total = 1.0, 0.0
    for r, x in enumerate(excess, 1):
        if x <= 0:
            break
        total += x
        best = min(best, math.exp(-total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)))
    return best


def probability(expected: float, base_rate: float) -> float:
    """Share of toxic documents among those with this much evidence."""
    return base_rate / (base_rate + (1 - base_rate) * expected) if base_rate > 0 else 0.0


def counted(position: np.ndarray, weight: np.ndarray, pair: np.ndarray, segments: list[tuple[int, int, float]], cost: float) -> list[tuple[int, int, float]]:
    """Segments as evidence: of equal pairs (token, token before) only one counts.

    It is the one in the best segment, so a dense passage keeps what stood singly before it.
    """
    if len(np.unique(pair)) == len(pair):
        return segments
    first, _, scores = (np.array(x) for x in zip(*segments))
    value = scores[np.searchsorted(first, position, "right") - 1]
    order = np.lexsort((position, -value))
    _, best = np.unique(pair[order], return_index=True)
    kept = np.sort(order[best])
    return maximal_segments(position[kept].tolist(), weight[kept].tolist(), cost)


def _findings(column: pa.Array, model: Model) -> Iterator[tuple]:
    """(row, segments, segments as evidence, tokens of the slice, row in slice) of every text.

    Segments are those of all tokens. As in learning, a token is evidence once for each
    token before it: what a text only says again, word for word, is no further evidence.
    """
    for base, texts in W.text_slices(column):
        w = Tokens(texts)
        at = np.minimum(np.searchsorted(model.tokens, w.hash), max(len(model.tokens) - 1, 0))
        hit = model.tokens[at] == w.hash if len(model.tokens) else np.zeros(len(w.hash), bool)
        where = np.flatnonzero(hit)
        _, pair = np.unique(np.stack([w.hash[where], w.before[where]]), axis=1, return_inverse=True)
        pair = pair.reshape(-1)
        limits = np.searchsorted(where, w.first)
        for d in range(len(texts)):
            own = slice(limits[d], limits[d + 1])
            position, weight = where[own] - w.first[d], model.weights[at[where[own]]]
            segments = maximal_segments(position.tolist(), weight.tolist(), model.cost)
            yield base + d, segments, counted(position, weight, pair[own], segments, model.cost), w, d


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` (0 to 1) to every row; other columns stay, one of that name is replaced.

    A null or empty text, and one without any finding, scores the base rate of the labels;
    with no labels of both kinds every score is 0.
    """

    @frugal
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.zeros(len(batch))
            for row, _, evidence, w, d in _findings(pa.array(batch, pa.string()), model):
                n = int(w.count[d])
                out[row] = probability(chance([s for _, _, s in evidence], n, model), model.base_rate)
            yield pd.Series(out)

    kept = [c for c in docs.columns if c.lower() != "score"]
    return docs.select(*[docs[f"`{c}`"] for c in kept], F.pandas_udf(rate, "double")(docs["text"]).alias("score"))


def passages(docs: DataFrame, model: Model, most_expected: float = 0.05) -> DataFrame:
    """Every significant segment: doc_id, start and end (bytes of the UTF-8 text), score, expected."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for row, segments, _, w, d in _findings(batch.column(1), model):
                base = int(w.limits[d])
                for a, b, s in segments:
                    expected = chance([s], int(w.count[d]), model)
                    if expected <= most_expected:
                        rows.append((row, int(w.start[w.first[d] + a]) - base, int(w.end[w.first[d] + b]) - base, s, expected))
            cols = list(zip(*rows)) or [[], [], [], [], []]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(arrays[0]), *arrays[1:]], names=["doc_id", "start", "end", "score", "expected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, "doc_id long, start long, end long, score double, expected double")
