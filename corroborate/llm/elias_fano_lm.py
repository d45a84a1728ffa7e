"""Language-model scores from a sharded Elias-Fano trie of word pairs.

Scan tasks cut their documents into blocks. A block asks for the counts of its distinct
words, then for the probabilities of its distinct word pairs; each shard adds up the counts
of its pairs, writes them as a trie and answers from it. A trie has two levels: context
words, and below each the words that follow it, numbered relative to their context. Both
levels and the pointers between them are monotone, so each is an Elias-Fano sequence;
smoothed probabilities are kept as bytes of a code book. Documents never leave their scan
task, only distinct pairs travel, packed.

P(w | v) = (c(vw) + MU P(w)) / (c(v) + MU), and P(w) discounts every count to leave room
for one unknown word, as large as the share of words seen once.
"""

from __future__ import annotations

import hashlib
import struct
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.llm import words as W
from corroborate.session import cut_lineage, scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_TOKENS = 1_000_000
SHARD_BYTES = 8 << 20  # of text whose pairs one shard receives
MU = 200.0
END = np.uint64(0x452821E638D01377)  # hashes of the marks after the last and before the first word
START = np.uint64(0xBE5466CF34E90C6C)
STEPS = 2048  # of a decade, for probabilities of single words on the wire


class EliasFano:
    """A monotone sequence of 64-bit numbers in about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        self.zeros = 64 * np.arange(len(high) + 1) - self.ones

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        words = np.zeros((n * low_bits + 63) // 64 + 2, np.uint64)
        part = values & np.uint64((1 << low_bits) - 1)
        at = np.arange(n, dtype=np.int64) * low_bits
        shift = (at & 63).astype(np.uint64)
        np.bitwise_or.at(words, at >> 6, part << shift)
        over = (at & 63) + low_bits > 64
        np.bitwise_or.at(words, (at[over] >> 6) + 1, part[over] >> (np.uint64(64) - shift[over]))
        bits = np.zeros(64 * (-(-(n + (top >> low_bits) + 1) // 64)), np.uint8)
        bits[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, low_bits, words, np.packbits(bits, bitorder="little").view("<u8"))

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low_bits
        shift = (at & 63).astype(np.uint64)
        a, b = self.low[at >> 6], self.low[(at >> 6) + 1]
        joined = (a >> shift) | np.where(shift > 0, b << (np.uint64(64) - np.maximum(shift, 1)), np.uint64(0))
        return joined & np.uint64((1 << self.low_bits) - 1)

    def _select(self, k: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the k-th one (or zero) of the high bits."""
        word = np.searchsorted(before, k, "right") - 1
        rest = (k - before[word]).astype(np.int64)
        value = ~self.high[word] if flip else self.high[word].copy()
        place = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(value & np.uint64((1 << width) - 1)).astype(np.int64)
            up = rest >= low
            rest -= np.where(up, low, 0)
            place += np.where(up, width, 0)
            value = np.where(up, value >> np.uint64(width), value)
        return 64 * word + place

    def get(self, i: np.ndarray) -> np.ndarray:
        high = self._select(i, self.ones, False) - i
        return high.astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first value >= x, whether it equals x)."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        low = x & np.uint64((1 << self.low_bits) - 1)
        beyond = high >= int(self.zeros[-1])
        high = np.minimum(high, int(self.zeros[-1]) - 1)
        at = np.where(high > 0, self._select(np.maximum(high - 1, 0), self.zeros, True) - np.maximum(high - 1, 0), 0)
        end = np.minimum(self._select(high, self.zeros, True) - high, self.n)
        at = np.where(beyond, self.n, np.minimum(at, self.n))
        todo = np.flatnonzero(at < end)
        while len(todo):
            todo = todo[self._low(at[todo]) < low[todo]]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        equal = ~beyond & (at < end)
        equal[equal] = self._low(at[equal]) == low[equal]
        return at, equal

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<i8"), self.low, self.high]


class Trie:
    """Contexts, pointers, followers and codes of one shard, on top of one read-only buffer."""

    def __init__(self, raw: memoryview):
        at, self.levels = 0, []
        for _ in range(3):
            n, low_bits, a, b = np.frombuffer(raw, "<i8", 4, at).tolist()
            low = np.frombuffer(raw, "<u8", a, at + 32)
            high = np.frombuffer(raw, "<u8", b, at + 32 + 8 * a)
            self.levels.append(EliasFano(n, low_bits, low, high))
            at += 32 + 8 * (a + b)
        self.contexts, self.pointers, self.followers = self.levels
        self.book = np.frombuffer(raw, "<f4", 256, at)
        self.codes = np.frombuffer(raw, np.uint8, self.followers.n, at + 1024)

    @staticmethod
    def build(context: np.ndarray, follower: np.ndarray, log_p: np.ndarray) -> bytes:
        """Bytes of the trie of distinct (context, follower), ordered by both."""
        keys, first = np.unique(context, return_index=True)
        rank = np.repeat(np.arange(len(keys), dtype=np.uint64), np.diff(np.append(first, len(context))))
        sequences = [keys, np.append(first, len(context)), rank << np.uint64(32) | follower]
        # Code 0 means absent; each other code is the mean of the values in a step of its own.
        low, high = (log_p.min(), log_p.max()) if len(log_p) else (0.0, 0.0)
        code = (1 + 254 * (log_p - low) / max(high - low, 1e-9)).round().astype(np.uint8)
        number = np.bincount(code, minlength=256)
        book = np.bincount(code, log_p, 256) / np.maximum(number, 1)
        out = [p for s in sequences for p in EliasFano.encode(s).parts()]
        return b"".join(p.tobytes() for p in [*out, book.astype("<f4"), code])

    def find(self, context: np.ndarray, follower: np.ndarray) -> np.ndarray:
        """Code of each pair, 0 if absent: the successor among the followers of its context."""
        out = np.zeros(len(context), np.uint8)
        keys, which = np.unique(context, return_inverse=True)
        rank, known = self.contexts.successor(keys)
        here = np.flatnonzero(known[which])
        rank = rank[which[here]]
        at, equal = self.followers.successor(rank.astype(np.uint64) << np.uint64(32) | follower[here])
        if len(here):
            equal &= (at >= self.pointers.get(rank).astype(np.int64)) & (at < self.pointers.get(rank + 1).astype(np.int64))
        out[here[equal]] = self.codes[at[equal]]
        return out


class _Block:
    """Documents of a scan task, in order: their ids, and their tokens with what stands before."""

    def __init__(self):
        self.rows, self.ids, self.token, self.before, self.doc, self.learn = 0, [], [], [], [], []
        self.size = 0

    def add(self, ids: pa.Array, learn: np.ndarray, texts: W.Texts) -> None:
        w = W.Words(texts)
        token = np.insert(w.hash, w.first[1:], END)
        ends = w.first[1:] + np.arange(len(texts))
        before = np.concatenate([[START], token[:-1]])
        before[np.concatenate([[0], ends[:-1] + 1])] = START
        doc = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=-1))
        self.ids.append(ids), self.token.append(token), self.before.append(before)
        self.doc.append(self.rows + doc), self.learn.append(learn[doc])
        self.rows += len(texts)
        self.size += len(token)

    def close(self, number: int) -> _Block:
        self.token, self.before, self.doc, self.learn = (np.concatenate(x) for x in (self.token, self.before, self.doc, self.learn))
        # The key holds place and content: a block of other rows does not find the answers of this one.
        place = struct.pack("<qq", TaskContext.get().partitionId(), number)
        content = hashlib.blake2b(place + self.token.tobytes() + self.learn.tobytes(), digest_size=8)
        self.key = int.from_bytes(content.digest(), "little") >> 1
        # Words of the block, with the context mark; a document lends it one start.
        self.words, which = np.unique(np.append(self.token, START), return_inverse=True)
        self.word = which[:-1]
        self.word_before = np.searchsorted(self.words, self.before)
        return self


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    """Blocks of whole documents from batches of (doc_id, text, learn); the same each time."""
    block, number = _Block(), 0
    for batch in batches:
        learn = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for first, texts in W.text_slices(batch.column(1)):
            block.add(batch.column(0).slice(first, len(texts)), learn[first : first + len(texts)], texts)
            if block.size >= BLOCK_TOKENS:
                yield block.close(number)
                block, number = _Block(), number + 1
    if block.rows:
        yield block.close(number)


REQUEST = "shard int, block long, size long, body binary"


def _row(shard: int, block: int, size: int, *arrays: np.ndarray) -> tuple:
    return shard, block, size, zlib.compress(b"".join(a.tobytes() for a in arrays), 1)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    columns = list(zip(*rows)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["shard", "block", "size", "body"])


def _ask_words(shards: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array([(s << 64) // shards for s in range(1, shards)], np.uint64)
        for b in _blocks(batches):
            counts = np.bincount(b.word, b.learn, len(b.words)).astype("<u4")
            at = int(np.searchsorted(b.words, START))
            counts[at] = int((b.learn & (b.before == START)).sum())
            cuts = np.concatenate([[0], np.searchsorted(b.words, bounds), [len(b.words)]]).tolist()
            yield _batch([_row(s, b.key, e - a, b.words[a:e], counts[a:e]) for s, (a, e) in enumerate(zip(cuts[:-1], cuts[1:])) if e > a])

    return ask


def _answer_words(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """Counts over all training text for every block, and the sums of this shard."""
    words, counts = [], []
    for size, body in zip(group["size"], group["body"]):
        raw = zlib.decompress(body)
        words.append(np.frombuffer(raw, "<u8", size)), counts.append(np.frombuffer(raw, "<u4", size, 8 * size))
    keys, which = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(which, np.concatenate(counts), len(keys)).astype(np.int64)
    own = total[(keys != START) & (total > 0)]
    sums = np.zeros((len(group), 3), np.int64)
    sums[0] = own.sum(), len(own), (own == 1).sum()
    limits = np.cumsum([0, *map(len, words)])
    bodies = [zlib.compress(total[which[a:e]].astype("<u8").tobytes(), 1) for a, e in zip(limits[:-1], limits[1:])]
    return pd.DataFrame({"shard": key[0], "block": group["block"], "body": bodies, "tokens": sums[:, 0], "kinds": sums[:, 1], "once": sums[:, 2]})


class _Unigram:
    """Base score and smoothed probability of single words from their counts."""

    def __init__(self, tokens: int, kinds: int, once: int):
        self.tokens, self.kinds = tokens, kinds
        self.discount = 0.95 * (once + 1) / (kinds + 1)
        self.base = float(np.log10(tokens + kinds + 1))

    def log_base(self, c: np.ndarray) -> np.ndarray:
        return np.log10(c + 1) - self.base

    def steps(self, c: np.ndarray) -> np.ndarray:
        """-log10 P(w), in steps."""
        if not self.kinds:
            return np.zeros(len(c), np.uint16)
        p = np.where(c > 0, c - self.discount, self.discount * self.kinds) / self.tokens
        return np.minimum(np.round(-STEPS * np.log10(p)), 65535).astype("<u2")


def _read(path: str, block: _Block) -> list[bytes]:
    """What each shard answered to the block."""
    files, base = pafs.FileSystem.from_uri(path)
    try:
        raw = files.open_input_stream(f"{base}/block-{block.key:016x}").read()
    except FileNotFoundError as error:
        raise RuntimeError("the documents were not read in the same blocks again") from error
    at, bodies = 0, []
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 8], "little")
        bodies.append(raw[at + 8 : at + 8 + size])
        at += 8 + size
    return bodies


def _read_counts(path: str, block: _Block) -> np.ndarray:
    return np.frombuffer(b"".join(map(zlib.decompress, _read(f"{path}/words", block))), "<u8").astype(np.int64)


def _write_answers(answers: DataFrame, path: str) -> None:
    """One file for each block: what the shards answered, by ascending shard."""

    def keep(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        files, base = pafs.FileSystem.from_uri(path)
        files.create_dir(base)
        name = f"{base}/block-{int(key[0]):016x}"
        own = f"{name}.{TaskContext.get().taskAttemptId()}"
        with files.open_output_stream(own) as out:
            for body in group.sort_values("shard")["body"]:
                out.write(len(body).to_bytes(8, "little") + body)
        files.move(own, name)
        return pd.DataFrame({"block": [key[0]]})

    answers.groupBy("block").applyInPandas(keep, "block long").count()


def _pairs(b: _Block, counts: np.ndarray, unigram: _Unigram, shards: int) -> tuple[np.ndarray, ...]:
    """Distinct pairs of a block by shard, context and follower: these, and each token's pair.

    A context as frequent as several shards hold is spread over them by its followers;
    how many follows from its count alone, so all blocks agree.
    """
    pair, which = np.unique(b.word_before.astype(np.int64) * len(b.words) + b.word, return_inverse=True)
    context, follower = pair // len(b.words), pair % len(b.words)
    spread = np.minimum(1 + 4 * shards * counts[context] // max(unigram.tokens, 1), shards).astype(np.uint64)
    key = b.words[context]
    shard = ((key >> np.uint64(20)) % np.uint64(shards) + (b.words[follower] >> np.uint64(32)) % spread) % np.uint64(shards)
    order = np.lexsort((b.words[follower] & np.uint64(0xFFFFFFFF), key, shard))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return shard[order].astype(np.int64), context[order], follower[order], place[which]


def _ask_pairs(path: str, unigram: _Unigram, shards: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            counts = _read_counts(path, b)
            shard, context, follower, place = _pairs(b, counts, unigram, shards)
            learned = np.minimum(np.bincount(place, b.learn, len(shard)), 2**32 - 1).astype("<u4")
            steps = unigram.steps(counts)
            rows, cuts = [], np.searchsorted(shard, np.arange(shards + 1)).tolist()
            for s, (a, e) in enumerate(zip(cuts[:-1], cuts[1:])):
                if e > a:
                    own, size = np.unique(context[a:e], return_counts=True)
                    low = (b.words[follower[a:e]] & np.uint64(0xFFFFFFFF)).astype("<u4")
                    head = np.array([len(own)], "<i8"), b.words[own], counts[own].astype("<u8"), size.astype("<u4")
                    rows.append(_row(s, b.key, e - a, *head, low, steps[follower[a:e]], learned[a:e]))
            yield _batch(rows)

    return ask


def _answer_pairs(path: str, mu: float):
    def answer(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """Build the trie of the shard from all blocks, map it, and answer every block from it."""
        context, total, follower, steps, learned = [], [], [], [], []
        for size, body in zip(group["size"], group["body"]):
            raw = zlib.decompress(body)
            k = int(np.frombuffer(raw, "<i8", 1)[0])
            n = np.frombuffer(raw, "<u4", k, 8 + 16 * k)
            context.append(np.repeat(np.frombuffer(raw, "<u8", k, 8), n))
            total.append(np.repeat(np.frombuffer(raw, "<u8", k, 8 + 8 * k), n))
            at = 8 + 20 * k
            follower.append(np.frombuffer(raw, "<u4", size, at)), steps.append(np.frombuffer(raw, "<u2", size, at + 4 * size))
            learned.append(np.frombuffer(raw, "<u4", size, at + 6 * size))
        limits = np.cumsum([0, *map(len, follower)])
        context, total, follower, steps, learned = (np.concatenate(x) for x in (context, total, follower, steps, learned))
        keys, rank = np.unique(context, return_inverse=True)
        pair, first, which = np.unique(rank.astype(np.uint64) << np.uint64(32) | follower, return_index=True, return_inverse=True)
        count = np.bincount(which, learned, len(pair))
        seen = np.flatnonzero(count)
        at = first[seen]
        p = (count[seen] + mu * 10.0 ** (-steps[at].astype(float) / STEPS)) / (total[at] + mu)
        raw = Trie.build(context[at], pair[seen] & np.uint64(0xFFFFFFFF), np.log10(p))
        files, base = pafs.FileSystem.from_uri(path)
        files.create_dir(f"{base}/trie")
        name = f"{base}/trie/shard-{int(key[0]):08d}"
        own = f"{name}.{TaskContext.get().taskAttemptId()}"
        with files.open_output_stream(own) as out:
            out.write(raw)
        files.move(own, name)
        trie = open_trie(path, int(key[0]))
        code = np.concatenate([trie.find(keys[(pair[a : a + 262_144] >> np.uint64(32)).astype(np.int64)], pair[a : a + 262_144] & np.uint64(0xFFFFFFFF)) for a in range(0, len(pair), 262_144)])
        book = trie.book.tobytes()
        bodies = [book + code[which[a:e]].tobytes() for a, e in zip(limits[:-1], limits[1:])]
        return pd.DataFrame({"shard": key[0], "block": group["block"], "body": bodies})

    return answer


def open_trie(path: str, shard: int) -> Trie:
    """A trie file: mapped into memory where the folder is a local one, else read."""
    files, base = pafs.FileSystem.from_uri(path)
    name = f"{base}/trie/shard-{shard:08d}"
    if isinstance(files, pafs.LocalFileSystem):
        mapped = pa.memory_map(name)
        return Trie(memoryview(mapped.read_buffer(mapped.size())))
    return Trie(memoryview(files.open_input_file(name).read()))


def _score(path: str, unigram: _Unigram, shards: int, mu: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            counts = _read_counts(path, b)
            shard, context, follower, place = _pairs(b, counts, unigram, shards)
            bodies = iter(_read(f"{path}/pairs", b))
            log_p = np.empty(len(shard))
            cuts = np.searchsorted(shard, np.arange(shards + 1)).tolist()
            single = -unigram.steps(counts)[follower].astype(float) / STEPS
            lost = np.log10(mu / (counts[context] + mu)) + single
            for a, e in zip(cuts[:-1], cuts[1:]):
                if e > a:
                    raw = next(bodies)
                    book, code = np.frombuffer(raw, "<f4", 256), np.frombuffer(raw, np.uint8, offset=1024)
                    log_p[a:e] = np.where(code > 0, book[code], lost[a:e])
            if next(bodies, None) is not None:
                raise RuntimeError("the documents were not read in the same blocks again")
            n = b.rows
            sums = [np.bincount(b.doc, minlength=n), np.bincount(b.doc, counts[b.word] > 0, n).astype(np.int64)]
            base = np.bincount(b.doc, unigram.log_base(counts[b.word]), n)
            arrays = [pa.concat_arrays(b.ids), *map(pa.array, sums), pa.array(np.full(n, unigram.tokens)), pa.array(base), pa.array(np.bincount(b.doc, log_p[place], n))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return score


def score_documents(docs: DataFrame, learn: str, mu: float = MU) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``learn`` names the boolean column of the rows to learn from (null: no). A null or empty
    text is its end mark alone. Repeated rows count as often as they stand. With nothing to
    learn from, every word is the unknown one, of probability 1. ``docs`` must read the same
    rows in the same order and partitions each time, as files do; a block that differs ends
    the run. Scores carry the quantisation of the trie: 255 levels of log-probability a shard.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col(learn), F.lit(False)).alias("learn"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    path = scratch_path(docs.sparkSession, "trie")
    answered = rows.mapInArrow(_ask_words(shards), REQUEST).groupBy("shard")
    answered = cut_lineage(answered.applyInPandas(_answer_words, "shard int, block long, body binary, tokens long, kinds long, once long"))
    sums = answered.agg(F.sum("tokens"), F.sum("kinds"), F.sum("once")).first()
    unigram = _Unigram(*(int(s or 0) for s in sums))
    _write_answers(answered, f"{path}/words")
    asked = rows.mapInArrow(_ask_pairs(path, unigram, shards), REQUEST)
    pairs = asked.groupBy("shard").applyInPandas(_answer_pairs(path, mu), "shard int, block long, body binary")
    _write_answers(pairs, f"{path}/pairs")
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.mapInArrow(_score(path, unigram, shards, mu), schema)
