"""Token ids of whole texts, each distinct piece of text encoded once per worker.

A text is cut where the tokenizer always starts a new pre-token, so the ids of the
text are those of its pieces in a row. Pieces repeat, and the library encodes the
distinct ones only; a bounded memo keeps them between batches.
"""

from __future__ import annotations

import os
import sys
import types
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from corroborate.llm import words as W

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MEMO_PIECES = 1 << 18
MEMO_BYTES = 16 << 20  # of the pieces and, as many again, of their ids
BATCH_BYTES = 4 << 20
JOINED = 16
_LETTERS = np.zeros(256, bool)
_LETTERS[np.r_[65:91, 97:123]] = True
# After an ASCII letter each of these starts a new pre-token in every tokenizer used here.
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in ".,;:!?"]] = True


def _unicode_space_before(data: np.ndarray) -> np.ndarray:
    """Whether the bytes before each position end a white-space character beyond ASCII."""
    padded = np.concatenate([np.zeros(3, np.uint8), data])
    a, b, c = padded[:-3], padded[1:-2], padded[2:-1]
    two = (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
    general = (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) & (c >= 0x80) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    rest = (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    return two | general | rest | (a == 0xE3) & (b == 0x80) & (c == 0x80)


def _after_letter(data: np.ndarray) -> np.ndarray:
    """Positions of a mark straight after a letter."""
    return np.flatnonzero(_LETTERS[data[:-1]] & _MARKS[data[1:]]) + 1


class SpacedPieces(W.Words):
    """Pieces that tile each text; they start where a run of white space or a mark starts."""

    def __init__(self, texts: W.Texts):
        n = len(texts.data)
        space = W.SPACES[texts.data]
        begins = np.zeros(n, bool)
        if n:
            begins[1:] = space[1:] & ~space[:-1]
            begins &= ~_unicode_space_before(texts.data)
            begins[_after_letter(texts.data)] = True
            begins[texts.limits[:-1][texts.limits[:-1] < n]] = True
        self.start = np.flatnonzero(begins)
        self.end = np.append(self.start[1:], n) if n else self.start
        self._file(texts)
        self.hash = W.hash_spans(texts, self.start, self.end, lower=False)


class WordPieces(W.Words):
    """Words between ASCII white space, marks apart, for tokenizers that drop white space."""

    def __init__(self, texts: W.Texts):
        n = len(texts.data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~W.SPACES[texts.data]
        begins = inside[1:] & ~inside[:-1]
        ends = inside[:-1] & ~inside[1:]
        cut = texts.limits[1:-1]
        cut = np.concatenate([cut[(cut > 0) & (cut < n)], _after_letter(texts.data)])
        begins[cut] = inside[cut + 1]
        ends[cut] = inside[cut]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends)
        self._file(texts)
        self.hash = W.hash_spans(texts, self.start, self.end, lower=False)


class _Memo:
    """Open-addressing table from 64-bit hash to entry number, looked up by whole arrays."""

    def __init__(self, slots: int = 2 * MEMO_PIECES):
        self.mask = np.uint64(slots - 1)
        self.key = np.zeros(slots, np.uint64)
        self.entry = np.full(slots, -1, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where unknown."""
        slot = (hashes & self.mask).astype(np.int64)
        out = self.entry[slot]
        todo = np.flatnonzero((self.key[slot] != hashes) & (out >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & int(self.mask)
            here = slot[todo]
            out[todo] = self.entry[here]
            todo = todo[(self.key[here] != hashes[todo]) & (out[todo] >= 0)]
        return out

    def add(self, hashes: np.ndarray, entries: np.ndarray) -> None:
        """Put distinct new hashes."""
        slot = (hashes & self.mask).astype(np.int64)
        todo = np.arange(len(hashes))
        while len(todo):
            free = self.entry[slot[todo]] < 0
            self.entry[slot[todo[free]]] = entries[todo[free]]
            self.key[slot[todo[free]]] = hashes[todo[free]]
            todo = todo[self.key[slot[todo]] != hashes[todo]]
            slot[todo] = (slot[todo] + 1) & int(self.mask)


class Encoder:
    """Ids of texts by the tokenizer file ``path``; ``end_id`` closes every text."""

    def __init__(self, path: str, end_id: int, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token.removesuffix("</w>"))
        self.spaced = spaced
        self.pieces = SpacedPieces if spaced else WordPieces
        self.end_id = end_id
        self._forget()

    def _forget(self) -> None:
        # Entry 0 is the end id.
        self.memo = _Memo()
        self.begin = np.array([0], np.int64)
        self.size = np.array([1], np.int32)
        self.pool = np.array([self.end_id], np.uint32)
        # The bytes of each piece, to tell a hit from another piece with the same hash.
        self.raw = b""
        self.raw_begin = np.array([0], np.int64)
        self.raw_size = np.array([0], np.int64)
        self.lanes = None

    def _joins(self, raw: list[bytes]) -> np.ndarray:
        """Which pieces can stand in a row of pieces and be told apart by their bytes."""
        out = np.ones(len(raw), bool)
        for i, r in enumerate(raw):
            if self.spaced and (r[:1] != b" " or r[-1:].isspace()):
                out[i] = False
            elif not r.isascii():
                text = r.decode("utf-8", "replace")
                alike = self.spaced or unicodedata.is_normalized("NFC", text) and len(text.lower().encode()) == len(r)
                out[i] = alike and len(text.split()) == 1
            elif b"<|" in r:
                out[i] = False
        return out

    def _encode(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and the ids of the pieces, encoded in rows and told apart by bytes."""
        batch = self.tokenizer.encode_batch_fast
        glue = b"" if self.spaced else b" "
        texts = [glue.join(raw[i : i + JOINED]).decode("utf-8", "replace") for i in range(0, len(raw), JOINED)]
        encoded = batch(texts, add_special_tokens=False)
        flat = np.fromiter(chain.from_iterable(e.ids for e in encoded), np.uint32)
        reached = np.cumsum(self.width[flat])
        want = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        at = np.searchsorted(reached, want)
        if len(flat) and at[-1] == len(flat) - 1 and (reached[at] == want).all():
            return np.diff(at, prepend=-1).astype(np.int32), flat
        return self._encode_each(raw)

    def _encode_each(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        encoded = self.tokenizer.encode_batch_fast([r.decode("utf-8", "replace") for r in raw], add_special_tokens=False)
        flat = np.fromiter(chain.from_iterable(e.ids for e in encoded), np.uint32)
        return np.fromiter((len(e.ids) for e in encoded), np.int32, len(raw)), flat

    def _learn(self, hashes: np.ndarray, raw: list[bytes], known: bool = True) -> np.ndarray:
        """Entries of new pieces; ``known`` ones are found by their hash from then on."""
        joins, made = self._joins(raw), np.zeros(len(raw), np.int32)
        for chosen, encode in ((joins, self._encode), (~joins, self._encode_each)):
            if chosen.any():
                size, flat = encode([raw[i] for i in np.flatnonzero(chosen)])
                entry = np.arange(len(self.begin), len(self.begin) + len(size), dtype=np.int32)
                if known:
                    self.memo.add(hashes[chosen], entry)
                made[chosen] = entry
                mine = [raw[i] for i in np.flatnonzero(chosen)]
                length = np.fromiter(map(len, mine), np.int64, len(mine))
                self.raw_begin = np.concatenate([self.raw_begin, len(self.raw) + np.cumsum(length) - length])
                self.raw_size = np.concatenate([self.raw_size, length])
                self.raw += b"".join(mine)
                self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(size, dtype=np.int64) - size])
                self.size = np.concatenate([self.size, size])
                self.pool = np.concatenate([self.pool, flat])
        self.lanes = W.lanes(np.frombuffer(self.raw, np.uint8))
        return made

    def _differ(self, texts: W.Texts, p: W.Words, entry: np.ndarray) -> np.ndarray:
        """Pieces whose bytes are not those of their entry."""
        size = p.end - p.start
        apart = size != self.raw_size[entry]
        todo = np.flatnonzero(~apart)
        own, kept, left = p.start[todo], self.raw_begin[entry[todo]], size[todo]
        wide = W.lanes(texts.data)
        while len(todo):
            mask = W._TAIL[np.minimum(left, 8)]
            wrong = (wide[own] & mask) != (self.lanes[kept] & mask)
            apart[todo[wrong]] = True
            more = (left > 8) & ~wrong
            todo, own, kept, left = todo[more], own[more] + 8, kept[more] + 8, left[more] - 8
            if len(todo) and (left > 8 * W.LANES).all():
                for i in todo.tolist():
                    begin = self.raw_begin[entry[i]]
                    apart[i] = texts.data[p.start[i] : p.end[i]].tobytes() != self.raw[begin : begin + size[i]]
                break
        return np.flatnonzero(apart)

    def batches(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids in a row, limits of the rows' ids) for consecutive rows."""
        for base, group in _grouped(column):
            parts = [(texts, self.pieces(texts)) for texts in group]
            entries = [self.memo.find(p.hash) for _, p in parts]
            missing = [np.flatnonzero(e < 0) for e in entries]
            unknown = np.concatenate([p.hash[m] for (_, p), m in zip(parts, missing)])
            if len(unknown):
                new, where = np.unique(unknown, return_index=True)
                if len(self.begin) + len(new) > MEMO_PIECES or max(len(self.raw), 4 * len(self.pool)) > MEMO_BYTES:
                    self._forget()
                    new, where = np.unique(np.concatenate([p.hash for _, p in parts]), return_index=True)
                    missing = [np.arange(len(p.hash)) for _, p in parts]
                raw = [
                    texts.data[s:e].tobytes()
                    for texts, p, chosen in _split(parts, missing, np.sort(where))
                    for s, e in zip(p.start[chosen].tolist(), p.end[chosen].tolist())
                ]
                self._learn(new[np.argsort(where)], raw)
                entries = [self.memo.find(p.hash) for _, p in parts]
            for (texts, p), entry in zip(parts, entries):
                other = self._differ(texts, p, entry)
                if len(other):
                    raw = [texts.data[s:e].tobytes() for s, e in zip(p.start[other].tolist(), p.end[other].tolist())]
                    entry[other] = self._learn(p.hash[other], raw, known=False)
                row = np.insert(entry, p.first[1:], 0)
                size = self.size[row].astype(np.int64)
                after = np.cumsum(size)
                total = int(after[-1])
                ids = self.pool[np.repeat(self.begin[row] - (after - size), size) + np.arange(total)]
                ends = p.first[1:] + np.arange(len(texts))
                yield base, ids, np.concatenate([[0], after[ends]])
                base += len(texts)


def _grouped(column: pa.Array) -> Iterator[tuple[int, list[W.Texts]]]:
    """(first row, slices) of about ``BATCH_BYTES``, so that a memo lookup serves many."""
    base, held, size = 0, [], 0
    for first, texts in W.text_slices(column):
        if not held:
            base = first
        held.append(texts)
        size += len(texts.data)
        if size >= BATCH_BYTES:
            yield base, held
            held, size = [], 0
    if held:
        yield base, held


def _split(parts, missing, where):
    """The chosen positions of the joined ``missing`` lists, part by part."""
    limits = np.concatenate([[0], np.cumsum([len(m) for m in missing])])
    for (texts, p), m, lo, hi in zip(parts, missing, limits[:-1], limits[1:]):
        inside = where[(where >= lo) & (where < hi)] - lo
        yield texts, p, m[inside]


def encoder(path: str, end_id: int, spaced: bool) -> Encoder:
    """The worker's encoder of this tokenizer file; it outlives the task, as does its memo."""
    kept = sys.modules.setdefault("_kept_encoders", types.ModuleType("_kept_encoders")).__dict__
    key = f"{path} {end_id} {spaced}"
    if key not in kept:
        kept[key] = Encoder(path, end_id, spaced)
    return kept[key]
