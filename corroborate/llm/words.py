"""Vectorised word and shingle hashing over slices of an Arrow text column.

A text is its UTF-8 bytes. Words are runs of bytes outside a set of separators, so
every rule that names ASCII separators only gives the same words as on characters.
Hashes are 64-bit: two different words or shingles share one with odds of 2**-64, if they
were not made to.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Workers receive the functions of this module by value and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE_BYTES = 1 << 18
LANES = 32  # of 8 bytes; longer spans are hashed one by one
_ODD = 0xBF58476D1CE4E5B9


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(_ODD)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# Whitespace of the contract: [\x20\x09-\x0D]
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_STEP = mix(np.arange(1000, 1064, dtype=np.uint64))


class Texts:
    """Bytes and document limits of a slice of a string array; null is empty."""

    def __init__(self, data: np.ndarray, limits: np.ndarray):
        self.data, self.limits = data, limits

    def __len__(self) -> int:
        return len(self.limits) - 1


def text_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, Texts]]:
    """(first row, texts) of consecutive whole documents of about ``size`` bytes."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    limits = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    limits = limits.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(limits, limits[first] + size, "right")) - 1)
        last = min(last, n)
        yield first, Texts(raw[limits[first] : limits[last]], limits[first : last + 1] - limits[first])
        first = last


_TAIL = np.array([(1 << 8 * r) - 1 for r in range(8)] + [(1 << 64) - 1], np.uint64)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))


def hash_spans(texts: Texts, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of the bytes of each span, A-Z lower-cased on request.

    Every eight bytes are mixed into the state before the next ones come, so no sum of bytes
    can cancel out; the length is mixed in first. Spans of over ``LANES`` times eight bytes
    get a cryptographic digest.
    """
    data = _LOWER[texts.data] if lower else texts.data
    wide = lanes(data)
    size = end - start
    state = mix(size.astype(np.uint64) + np.uint64(_ODD))
    todo = np.flatnonzero((size > 0) & (size <= 8 * LANES))
    at, left = start[todo], size[todo]
    while len(todo):
        state[todo] = mix(state[todo] ^ (wide[at] & _TAIL[np.minimum(left, 8)]))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > 8 * LANES).tolist():
        state[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return state


class Words:
    """Words of a slice: ``start``/``end`` bytes, ``doc`` (row in slice), ``hash``."""

    def __init__(self, texts: Texts, separators: np.ndarray = SPACES, lower: bool = True):
        n = len(texts.data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~separators[texts.data]
        begins = inside[1:] & ~inside[:-1]
        ends = inside[:-1] & ~inside[1:]
        # A document limit inside a run of word bytes parts two words.
        cut = texts.limits[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        begins[cut] = inside[cut + 1]
        ends[cut] = inside[cut]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends)
        self._file(texts)
        self.hash = hash_spans(texts, self.start, self.end, lower)

    def _file(self, texts: Texts) -> None:
        # Words of document d are first[d] .. first[d + 1].
        self.limits = texts.limits
        self.first = np.searchsorted(self.start, texts.limits)
        self.count = np.diff(self.first)
        self.n_docs = len(texts)
        self.doc = np.repeat(np.arange(self.n_docs), self.count)


def shingles(words: Words, k: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of ``k`` words; of a shorter document, of all its words."""
    h, n = words.hash, len(words.hash)
    out = np.zeros(n, np.uint64)
    left = words.first[words.doc + 1] - np.arange(n)
    for i in range(k):
        reach = np.minimum(np.arange(n) + i, max(n - 1, 0))
        term = mix(h[reach] + _STEP[i])
        out += np.where(left > i, term, np.uint64(0))
    keep = left >= k
    if whole_if_short:
        keep |= (words.count[words.doc] < k) & (np.arange(n) == words.first[words.doc])
    return words.doc[keep], mix(out[keep])


def distinct_per_doc(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, value), ordered by both."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[fresh], value[fresh]
