"""Token counts of whole texts by byte-pair merging, without making ids.

A text becomes pieces by the rules of the vocabulary file. The symbols of a piece stand in a
doubly linked list; the adjacent pair of the lowest rank is popped from a heap and merged
until no pair has a rank. A piece has as many tokens as it had symbols, less its merges.
"""

from __future__ import annotations

import heapq
import json
import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MEMO_PIECES = 400_000  # whose counts a worker keeps, twice at most
MEMO_PIECE = 64  # characters; longer pieces are counted each time
SEGMENT = 1 << 16  # characters of a text that are cut into pieces at once
# Characters with the White_Space property.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def merge_count(symbols: list[int], ranks: dict[int, int], made: list[int]) -> int:
    """How many merges the symbols allow.

    ``ranks`` has the rank of the pair (left << 32 | right), ``made`` the symbol that each
    rank merges to. A heap entry is rank << 32 | place; among equal ranks the leftmost goes
    first. An entry is stale when the pair at its place has another rank by then.
    """
    n = len(symbols)
    heap = []
    for i in range(n - 1):
        rank = ranks.get(symbols[i] << 32 | symbols[i + 1])
        if rank is not None:
            heap.append(rank << 32 | i)
    if not heap:
        return 0
    if len(heap) == 1 and n == 2:
        return 1
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    symbols = [*symbols, -1]
    merges = 0
    while heap:
        top = heapq.heappop(heap)
        i, rank = top & 0xFFFFFFFF, top >> 32
        j = after[i]
        if j >= n or symbols[i] < 0 or ranks.get(symbols[i] << 32 | symbols[j]) != rank:
            continue
        symbols[i], symbols[j] = made[rank], -1
        k = after[i] = after[j]
        merges += 1
        if k < n:
            before[k] = i
            found = ranks.get(symbols[i] << 32 | symbols[k])
            if found is not None:
                heapq.heappush(heap, found << 32 | i)
        h = before[i]
        if h >= 0:
            found = ranks.get(symbols[h] << 32 | symbols[i])
            if found is not None:
                heapq.heappush(heap, found << 32 | h)
    return merges


class Counter:
    """Counts tokens by a byte-level vocabulary file whose pieces end with a word-end mark."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        model, split = rules["model"], rules["pre_tokenizer"]["pretokenizers"][0]
        kinds = [p["type"] for p in rules["pre_tokenizer"]["pretokenizers"]]
        if model["type"] != "BPE" or kinds != ["Split", "ByteLevel"] or not split["invert"]:
            raise ValueError(f"{path}: not a byte-level vocabulary with split words")
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {vocab[a] << 32 | vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        symbols = byte_symbols()
        self.inner = [vocab.get(s) for s in symbols]
        self.last = [vocab.get(s + self.suffix) for s in symbols]
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"\s", WHITE)).findall
        special = [regex.escape(t["content"]) for t in rules["added_tokens"] if t["special"]]
        self.special = regex.compile("|".join(special)) if special else None
        self.gap = regex.compile(f"[{WHITE}]")
        self.normalise = Tokenizer.from_file(path).normalizer.normalize_str
        self.lowers = "Lowercase" in [n["type"] for n in rules["normalizer"]["normalizers"]]
        # A full memo becomes the older one; pieces found there move on to the new one.
        self.memo: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def of_piece(self, piece: str) -> int:
        raw = piece.encode()
        symbols = [self.inner[b] for b in raw[:-1]]
        symbols.append(self.last[raw[-1]])
        if None in symbols:
            symbols = [s for s in symbols if s is not None]
        return len(symbols) - merge_count(symbols, self.ranks, self.made)

    def _learn(self, piece: str) -> int:
        count = self.older.get(piece)
        if count is None:
            count = self.of_piece(piece)
        if len(piece) <= MEMO_PIECE:
            if len(self.memo) >= MEMO_PIECES:
                self.memo, self.older = {}, self.memo
            self.memo[piece] = count
        return count

    def _segments(self, text: str) -> Iterator[str]:
        """``text`` cut before white space, which no piece and no composed character spans."""
        at = 0
        while len(text) - at > SEGMENT:
            found = self.gap.search(text, at + SEGMENT)
            end = found.start() if found else len(text)
            yield text[at:end]
            at = end
        yield text[at:]

    def of_text(self, text: str) -> int:
        total = 0
        if self.special and "<" in text:
            parts = self.special.split(text)
            total += len(parts) - 1
        else:
            parts = [text]
        for segment in (s for part in parts for s in self._segments(part)):
            if not segment.isascii():
                segment = self.normalise(segment)
            elif self.lowers:
                segment = segment.lower()
            get = self.memo.get
            for piece in self.pieces(segment):
                count = get(piece)
                if count is None:
                    count = self._learn(piece)
                    get = self.memo.get
                total += count
        return total


def counter(path: str) -> Counter:
    """The worker's counter for this file; it outlives the task, as does its bounded memo."""
    kept = sys.modules.setdefault("_kept_counters", types.ModuleType("_kept_counters")).__dict__
    if path not in kept:
        kept[path] = Counter(path)
    return kept[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    A null text counts as an empty one: no bytes, no tokens. Texts of any length are counted
    whole, in segments cut at white space. Repeated rows and null ids each keep their row;
    columns beside doc_id and text are not read. Special tokens of the vocabulary that stand
    in a text count once each, as in the tokenizers library. Needs no shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            numbers = [own.of_text(t) if t else 0 for t in batch.column(1).to_pylist()]
            arrays = [batch.column(0), batch.column(2), pa.array(numbers, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    found = docs.select("doc_id", "text", size).mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
