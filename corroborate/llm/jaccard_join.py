"""Exact Jaccard join of word n-grams with vertical partitioning.

All n-grams get one global order, by the number of documents that have them. The order is
cut into fragments; the n-grams that two documents share are counted fragment by fragment
and summed. Which pairs are counted follows from the rarest n-grams of each set (those
that a linked set cannot miss altogether), and from hubs: of all sets that meet in an
n-gram, the smallest is compared with each of the others. Two of these that are not
linked to their hub can only be linked if they share enough n-grams that the hub lacks,
so they meet again in those. Copies of one set are one set throughout, and sets known to be
in one component are not compared again: a large group of near copies costs a few
comparisons a member, not one a pair.
"""

from __future__ import annotations

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
from corroborate.llm.memory import frugal
from corroborate.operators.entity import connected_components
from corroborate.session import cut_lineage, remove_scratch, scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARD_BYTES = 12 << 20  # of text whose n-grams one counting task receives
FLUSH_KEYS = 1 << 22
KEY_BITS = 48
SMALL_POSTING = 32  # sets that are all compared with each other
BLOCK = 256
BLOCK_GRAMS = 1 << 18
MATRIX_CELLS = 1 << 21  # of the sets by n-grams matrix that is multiplied at once
STAR_ROUNDS = 1
NONE = b""
# A set in a posting: what it has from this n-gram on, and what it shares with the hub above.
POSTING = "context binary, token long, signature binary, n long, rest long, shared long"
POSTING_NAMES = [field.split()[0] for field in POSTING.split(", ")]


def frequency_code(count: np.ndarray) -> np.ndarray:
    """Document frequency in a byte: exact below 128, then eight steps to a doubling."""
    high = 128 + 8 * np.log2(np.maximum(count, 128) / 128)
    return np.where(count < 128, count, np.minimum(high, 255)).astype(np.uint8)


def fragment_of(code: np.ndarray) -> np.ndarray:
    """Fragment of the global order: one for each doubling of the frequency, up to 128."""
    return np.log2(np.minimum(code, 128).astype(float)).astype(np.int32)


def _pack(keys: np.ndarray) -> bytes:
    """Ascending 48-bit keys as differences of four bytes where these suffice."""
    steps = np.diff(keys, prepend=np.uint64(0))
    wide = len(steps) and int(steps.max()) >= 1 << 32
    return (b"8" if wide else b"4") + steps.astype("<u8" if wide else "<u4").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, f"<u{chr(raw[0])}", offset=1).astype(np.uint64), dtype=np.uint64)


class _Sets:
    """N-gram sets of the texts of a slice: ``value`` by document, sizes and signatures."""

    def __init__(self, texts: W.Texts, width: int):
        doc, self.value = W.distinct_per_doc(*W.shingles(W.Words(texts), width))
        self.limits = np.searchsorted(doc, np.arange(len(texts) + 1))
        self.size = np.diff(self.limits)
        self.doc = doc
        # Two sums of mixed hashes tell different sets apart, with odds of 2**-128.
        sums = []
        for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(self.value ^ np.uint64(salt)), dtype=np.uint64)])
            sums.append((total[self.limits[1:]] - total[self.limits[:-1]]).tolist())
        self.signature = [a.to_bytes(8, "big") + b.to_bytes(8, "big") if n else None for a, b, n in zip(*sums, self.size.tolist())]


def _written(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` (doc_id, text) written once, each row with the chunk it belongs to from then on.

    Later scans may split the files in any way: the chunk is in the rows.
    """
    docs = docs.withColumn("chunk", F.spark_partition_id())
    docs.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path)


def _stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to compressed files and read again."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(chunk, rows) for each run of rows of one chunk."""
    chunk = batch.column("chunk").to_numpy()
    cuts = np.flatnonzero(np.diff(chunk)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(chunk)]):
        if b > a:
            yield int(chunk[a]), batch.slice(a, b - a)


def _rows(signatures: list[bytes | None]) -> np.ndarray:
    """Ascending keys that tell whether rows are those that asked."""
    return np.unique(np.array([int.from_bytes(s[:6], "big") for s in signatures if s is not None], np.uint64))


def _requests(docs: DataFrame, width: int, shards: int) -> DataFrame:
    """shard, chunk, keys, counts: n-grams of each chunk, cut by ranges of their keys.

    Shard -1 - chunk has no counts; its keys are those of the rows that ask.
    """

    @frugal
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, seen, held, size = None, set(), [], 0

        def rows() -> pa.RecordBatch:
            arrays = [pa.array([-1 - chunk], pa.int32()), pa.array([chunk], pa.int32()), pa.array([_pack(_rows(list(seen)))], pa.binary()), pa.array([None], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["shard", "chunk", "keys", "counts"])

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([np.zeros(0, np.uint64), *held])
            held.clear()  # few copies of the keys are held at once
            keys.sort()
            fresh = np.ones(len(keys), bool)
            fresh[1:] = keys[1:] != keys[:-1]
            counts = np.diff(np.append(np.flatnonzero(fresh), len(keys)).astype(np.int32))
            keys = keys[fresh]
            bounds = np.array([(s << KEY_BITS) // shards for s in range(1, shards)], np.uint64)
            cuts = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
            some = [s for s in range(shards) if cuts[s + 1] > cuts[s]]
            packed = [_pack(keys[cuts[s] : cuts[s + 1]]) for s in some]
            small = [zlib.compress(np.minimum(counts[cuts[s] : cuts[s + 1]], 65535).astype("<u2").tobytes(), 1) for s in some]
            arrays = [pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.int32()), pa.array(packed, pa.binary()), pa.array(small, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["shard", "chunk", "keys", "counts"])

        for own, part in (p for batch in batches for p in _chunks(batch)):
            if own != chunk:
                if chunk is not None:
                    yield flush()
                    yield rows()
                chunk, seen, held, size = own, set(), [], 0
            for _, texts in W.text_slices(part.column(0)):
                sets = _Sets(texts, width)
                fresh = np.zeros(len(texts), bool)
                for i, s in enumerate(sets.signature):
                    if s is not None and s not in seen:
                        seen.add(s)
                        fresh[i] = True
                held.append(sets.value[fresh[sets.doc]] >> np.uint64(64 - KEY_BITS))
                size += len(held[-1])
                if size >= FLUSH_KEYS:
                    yield flush()
                    held, size = [], 0
        if chunk is not None:
            yield flush()
            yield rows()

    return docs.select("text", "chunk").mapInArrow(ask, "shard int, chunk int, keys binary, counts binary")


def _count(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """For each chunk the n-grams of one shard that at least two documents have."""
    if key[0] < 0:
        return group[["chunk", "keys"]].assign(codes=None)
    parts = [_unpack(k) for k in group["keys"]]
    counts = np.concatenate([np.frombuffer(zlib.decompress(c), "<u2") for c in group["counts"]])
    _, which = np.unique(np.concatenate(parts), return_inverse=True)
    code = frequency_code(np.bincount(which, counts))[which]
    out, at = [], 0
    for chunk, keys in zip(group["chunk"], parts):
        mine = code[at : at + len(keys)]
        at += len(keys)
        shared = mine > 1
        out.append((chunk, _pack(keys[shared]), mine[shared].tobytes()))
    return pd.DataFrame(out, columns=["chunk", "keys", "codes"])


def _frequencies(docs: DataFrame, width: int, path: str) -> None:
    """Write, for every chunk, the shared n-grams of its rows and their frequencies, and its rows' keys."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))

    def keep(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = group["codes"].isna()
        asked = np.unique(np.concatenate([_unpack(k) for k in group["keys"][rows]]))
        keys = np.concatenate([np.zeros(0, np.uint64), *(_unpack(k) for k in group["keys"][~rows])])
        codes = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(c, np.uint8) for c in group["codes"][~rows])])
        keys, first = np.unique(keys, return_index=True)
        files, base = pafs.FileSystem.from_uri(path)
        files.create_dir(base)
        name = f"{base}/chunk-{int(key[0]):08d}"
        own = f"{name}.{TaskContext.get().taskAttemptId()}"
        with files.open_output_stream(own) as out:
            shared = _pack(keys)
            out.write(np.array([len(keys), len(shared)], "<i8").tobytes() + codes[first].tobytes() + shared + _pack(asked))
        files.move(own, name)
        return pd.DataFrame({"chunk": [key[0]], "n": [len(keys)]})

    asked = _requests(docs, width, shards)
    answered = asked.groupBy("shard").applyInPandas(_count, "chunk int, keys binary, codes binary")
    answered.groupBy("chunk").applyInPandas(keep, "chunk int, n long").agg(F.sum("n")).collect()


class _Known:
    """Frequencies of the n-grams of one chunk."""

    def __init__(self, path: str, chunk: int):
        files, base = pafs.FileSystem.from_uri(path)
        name = f"{base}/chunk-{chunk:08d}"
        if files.get_file_info(name).type != pafs.FileType.File:
            raise RuntimeError(f"chunk {chunk} has no frequencies: {name}")
        raw = files.open_input_stream(name).read()
        n, packed = np.frombuffer(raw, "<i8", 2).tolist()
        self.chunk = chunk
        self.codes = np.frombuffer(raw, np.uint8, n, 16)
        self.keys = _unpack(raw[16 + n : 16 + n + packed])
        self.asked = _unpack(raw[16 + n + packed :])

    def of(self, sets: _Sets) -> np.ndarray:
        """Codes of all n-grams; one that is not shared occurs nowhere else, as its row did ask."""
        if not np.isin(_rows(sets.signature), self.asked, assume_unique=True).all():
            raise RuntimeError(f"rows of chunk {self.chunk} differ from those that asked for frequencies")
        if not len(self.keys):
            return np.ones(len(sets.value), np.uint8)
        keys = sets.value >> np.uint64(64 - KEY_BITS)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.codes[at], 1).astype(np.uint8)


def prefix_length(n: int, num: int, den: int) -> int:
    """How many of the first n-grams of a set of ``n`` no linked set can miss altogether."""
    return n - -(-num * n // den) + 1


def _sets(docs: DataFrame, width: int, num: int, den: int, path: str) -> DataFrame:
    """doc_id, n, signature; and for sets that may be linked their n-grams in global order."""
    schema = "doc_id long, text_key long, n long, signature binary, tokens binary, codes binary"

    @frugal
    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = None, set()
        for chunk, batch in (p for batch in batches for p in _chunks(batch)):
            if known is None or known.chunk != chunk:
                known = None  # one chunk is held at a time
                known = _Known(path, chunk)
            for first, texts in W.text_slices(batch.column(1)):
                sets = _Sets(texts, width)
                code = known.of(sets)
                alone = np.bincount(sets.doc, code == 1, len(texts)).astype(np.int64)
                tokens, codes = [None] * len(texts), [None] * len(texts)
                for i in np.flatnonzero(alone < sets.size - -(-num * sets.size // den) + 1).tolist():
                    if not sets.size[i] or sets.signature[i] in seen:
                        continue
                    seen.add(sets.signature[i])
                    own = slice(sets.limits[i], sets.limits[i + 1])
                    by = np.lexsort((sets.value[own], code[own]))
                    tokens[i], codes[i] = sets.value[own][by].tobytes(), code[own][by].tobytes()
                arrays = [batch.column(0).slice(first, len(texts)), batch.column(2).slice(first, len(texts)), pa.array(sets.size), pa.array(sets.signature, pa.binary()), pa.array(tokens, pa.binary()), pa.array(codes, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "n", "signature", "tokens", "codes"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"), "chunk").mapInArrow(order, schema)


def _first_postings(active: DataFrame, num: int, den: int) -> DataFrame:
    """context, token, signature, n: every shared n-gram in the prefix of a set."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found, rest = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, (n, tokens, codes) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                p = prefix_length(n, num, den)
                shared = np.frombuffer(codes, np.uint8)[:p] > 1
                found.append(np.frombuffer(tokens, "<i8")[:p][shared])
                rows.append(np.full(len(found[-1]), i))
                rest.append(n - np.flatnonzero(shared))
            at = pa.array(np.concatenate(rows))
            arrays = [pa.array([NONE] * len(at), pa.binary()), pa.array(np.concatenate(found)), batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(rest)), pa.array(np.zeros(len(at), np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=POSTING_NAMES)

    return active.select("signature", "n", "tokens", "codes").mapInArrow(post, POSTING)


def _segments(active: DataFrame) -> DataFrame:
    """signature, fragment, tokens, codes: each set cut by the fragments of the global order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, fragments, tokens, codes = [], [], [], []
            for i, (t, c) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                code = np.frombuffer(c, np.uint8)
                which = fragment_of(code)
                for f in np.unique(which).tolist():
                    a, b = np.searchsorted(which, [f, f + 1]).tolist()
                    rows.append(i), fragments.append(f), tokens.append(t[8 * a : 8 * b]), codes.append(c[a:b])
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(fragments, pa.int32()), pa.array(tokens, pa.binary()), pa.array(codes, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["signature", "fragment", "tokens", "codes"])

    return active.select("signature", "tokens", "codes").mapInArrow(cut, "signature binary, fragment int, tokens binary, codes binary")


def _overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """hub, hub_n, signature, n, shared, and extra: the n-grams of the set that the hub lacks.

    Every fragment counts on its own; the counts of a pair are summed.
    """
    schema = "hub binary, hub_n long, signature binary, n long, fragment int, shared long, tokens binary, codes binary"

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, tokens, codes = [], [], []
            for t, c, h in zip(*(batch.column(i).to_pylist() for i in (5, 6, 7))):
                own = np.frombuffer(t, "<u8")
                common = np.isin(own, np.frombuffer(h, "<u8"), assume_unique=True) if h else np.zeros(len(own), bool)
                shared.append(int(common.sum()))
                tokens.append(own[~common].tobytes())
                codes.append(np.frombuffer(c, np.uint8)[~common].tobytes())
            arrays = [*batch.columns[:5], pa.array(shared, pa.int64()), pa.array(tokens, pa.binary()), pa.array(codes, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["hub", "hub_n", "signature", "n", "fragment", "shared", "tokens", "codes"])

    of_hub = segments.select(F.col("signature").alias("hub"), "fragment", F.col("tokens").alias("hub_tokens"))
    both = pairs.join(segments, "signature").join(of_hub, ["hub", "fragment"], "left")
    parts = both.select("hub", "hub_n", "signature", "n", "fragment", "tokens", "codes", "hub_tokens")
    parts = parts.select("hub", "hub_n", "signature", "n", "fragment", "tokens", "codes", "hub_tokens").mapInArrow(count, schema)
    extra = F.array_sort(F.collect_list(F.struct("fragment", "tokens", "codes"))).alias("extra")
    return parts.groupBy("hub", "hub_n", "signature", "n").agg(F.sum("shared").alias("shared"), extra)


def _next_postings(met: DataFrame, num: int, den: int) -> DataFrame:
    """Postings below each hub, from the n-grams that its partners have beside it."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found, rest = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            columns = (batch.column(i).to_pylist() for i in (1, 3, 4, 5))
            for i, (hub_n, n, shared, extra) in enumerate(zip(*columns)):
                tokens = np.concatenate([np.frombuffer(e["tokens"], "<i8") for e in extra])
                codes = np.concatenate([np.frombuffer(e["codes"], np.uint8) for e in extra])
                least = max(-(-num * n // den), -(-num * (n + hub_n) // (num + den))) - shared
                p = len(tokens) - max(least, 1) + 1
                found.append(tokens[:p][codes[:p] > 1])
                rows.append(np.full(len(found[-1]), i))
                rest.append(len(tokens) - np.flatnonzero(codes[:p] > 1))
            at = pa.array(np.concatenate(rows))
            arrays = [batch.column(0).take(at), pa.array(np.concatenate(found)), *(batch.column(c).take(at) for c in (2, 3)), pa.array(np.concatenate(rest)), batch.column(4).take(at)]
            yield pa.RecordBatch.from_arrays(arrays, names=POSTING_NAMES)

    wanted = met.select("hub", "hub_n", "signature", "n", "shared", "extra")
    return wanted.mapInArrow(post, POSTING)


class _Group:
    """Sets that are all compared with each other, in one block or between two."""

    def __init__(self):
        self.names, self.roots, self.side, self.tokens, self.codes = [], [], [], [], []

    def add(self, name: bytes, root: bytes, side: int, tokens: bytes, codes: bytes) -> None:
        self.names.append(name), self.roots.append(root), self.side.append(side)
        self.tokens.append(np.frombuffer(tokens, "<u8")), self.codes.append(np.frombuffer(codes, np.uint8))

    def links(self, num: int, den: int) -> Iterator[tuple[bytes, bytes]]:
        """Links between sets that are not connected, no more than connect them."""
        size = np.array([len(t) for t in self.tokens])
        row = np.repeat(np.arange(len(size)), size)
        distinct, which, times = np.unique(np.concatenate(self.tokens), return_inverse=True, return_counts=True)
        fragment = np.zeros(len(distinct), np.int32)
        fragment[which] = fragment_of(np.concatenate(self.codes))
        shared = np.zeros((len(size), len(size)), np.float32)
        for f in np.unique(fragment).tolist():
            here = np.flatnonzero((fragment == f) & (times > 1))
            wide = max(1, MATRIX_CELLS // len(size))
            for at in range(0, len(here), wide):
                column = np.full(len(distinct), -1, np.int32)
                column[here[at : at + wide]] = np.arange(len(here[at : at + wide]))
                place = column[which]
                inside = place >= 0
                has = np.zeros((len(size), len(here[at : at + wide])), np.float32)
                has[row[inside], place[inside]] = 1
                shared += has @ has.T
        shared = shared.astype(np.int64)
        linked = den * shared >= num * (size[:, None] + size[None, :] - shared)
        side, two = np.array(self.side), len(set(self.side)) > 1
        group = {r: r for r in self.roots}
        for i, j in zip(*np.nonzero(np.triu(linked & ((side[:, None] != side[None, :]) | (not two)), 1))):
            a, b = self.roots[i], self.roots[j]
            while group[a] != a:
                a = group[a]
            while group[b] != b:
                b = group[b]
            if a != b:
                group[a] = b
                yield self.names[i], self.names[j]


def _compare_blocks(members: DataFrame, few: DataFrame, active: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) within the postings ``few``, each set compared with each other.

    Sets are dealt to blocks of about ``BLOCK`` sets or ``BLOCK_GRAMS`` n-grams and every two blocks meet in a task; only
    links come out, at most one for each set.
    """
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("total") / BLOCK_GRAMS)).cast("int")
    own = members.join(few.select("context", "token", "m", "total"), ["context", "token"])
    own = own.withColumn("_block", F.pmod(F.xxhash64("signature"), blocks).cast("int"))
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    met = own.select("context", "token", "signature", "root", "_block", every.alias("_other"))
    group = F.xxhash64("context", "token", F.least("_block", "_other"), F.greatest("_block", "_other"))
    met = met.select(group.alias("group"), "signature", "root", F.col("_block").alias("side"))
    rows = met.join(active.select("signature", "tokens", "codes"), "signature")

    @frugal
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, _Group()

        def finish() -> pa.RecordBatch:
            found = list(held.links(num, den)) if len(held.names) > 1 else []
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        for batch in batches:
            for group, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if group != current:
                    yield finish()
                    current, held = group, _Group()
                held.add(*rest)
        yield finish()

    ordered = rows.select("group", "signature", "root", "side", "tokens", "codes").repartition("group").sortWithinPartitions("group")
    return ordered.mapInArrow(compare, "a binary, b binary")


def _distinct_groups(members: DataFrame) -> DataFrame:
    """Postings with sets that are not connected: context, token, m, total, hub, hub_n.

    Of postings with the same sets the first in the global order says all; the sets of a
    group of near copies share many.
    """
    groups = members.groupBy("context", "token").agg(
        F.min(F.struct("n", "signature")).alias("hub"),
        F.min("root").alias("low"),
        F.max("root").alias("high"),
        F.count(F.lit(1)).alias("m"),
        F.sum(F.xxhash64("signature").cast("decimal(20,0)")).alias("who"),
        F.sum("rest").alias("reach"),
        F.sum("n").alias("total"),
    )
    first = groups.filter("low <> high").groupBy("context", "m", "total", "who").agg(F.max_by(F.struct("token", "hub"), F.struct("reach", "token")).alias("g"))
    return first.select("context", F.col("g.token").alias("token"), "m", "total", F.col("g.hub.signature").alias("hub"), F.col("g.hub.n").alias("hub_n"))


def links(active: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between sets, enough to connect every two sets that are linked.

    Each round compares the hub of every large posting with its other sets, and all sets
    of a small posting with each other. Postings whose sets are connected already are left.
    What large postings leave goes on to smaller ones; what is still large after
    ``STAR_ROUNDS`` is compared block by block.
    """
    path = scratch_path(active.sparkSession, "postings")
    postings = _stored(_first_postings(active, num, den), f"{path}/first")
    roots, done, direct, edges = None, None, None, None
    for level in range(STAR_ROUNDS + 1):
        if roots is None:  # nothing is connected yet
            members = postings.withColumn("root", F.col("signature"))
        else:
            members = postings.join(roots, "signature", "left").withColumn("root", F.coalesce("root", "signature"))
            members = _stored(members, f"{path}/level-{level}")
        groups = cut_lineage(_distinct_groups(members))
        small = F.lit(level == STAR_ROUNDS) | (F.col("m") <= SMALL_POSTING)
        met = cut_lineage(_compare_blocks(members, groups.filter(small), active, num, den))
        direct = met if direct is None else direct.unionByName(met)
        star = members.join(groups.filter(~small).drop("m", "total"), ["context", "token"]).filter("signature <> hub")
        star = cut_lineage(star.select("hub", "hub_n", "signature", "n").distinct())
        new = star if done is None else star.join(done.select("hub", "signature"), ["hub", "signature"], "left_anti")
        # Only sets of large postings are cut into segments.
        named = new.select("signature").unionByName(new.select(F.col("hub").alias("signature"))).distinct()
        segments = cut_lineage(_segments(active.join(named, "signature", "left_semi")))
        counted = cut_lineage(_overlaps(new, segments))
        done = counted if done is None else done.unionByName(counted)
        enough = den * F.col("shared") >= num * (F.col("n") + F.col("hub_n") - F.col("shared"))
        edges = direct.unionByName(done.filter(enough).select(F.col("hub").alias("a"), F.col("signature").alias("b")))
        if star.isEmpty():
            break
        below = done.join(star.select("hub", "signature"), ["hub", "signature"], "left_semi")
        postings = _next_postings(below, num, den)
        roots = connected_components(edges).withColumnRenamed("node", "signature")
    remove_scratch(active.sparkSession, path)  # links stand in checkpoints
    return edges


def similar_documents(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, n_shingles, component_id, component.

    Two rows link where den * |A and B| >= num * |A or B| for their sets of distinct
    ``width``-word shingles (all words of a shorter text are one); component_id is the
    smallest doc_id that links reach. Equal rows and equal sets share a component. A text
    that is null or without words has an empty set, component null, and stands alone. A null
    doc_id never is the smallest. ``text_key`` is the hash of the text. ``docs`` is read once
    and written with chunk numbers that all later scans go by; these files are removed when
    the sets stand in checkpoints.
    """
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "jaccard")
    docs = _written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), f"{path}/documents")
    _frequencies(docs, width, f"{path}/frequencies")
    _sets(docs, width, num, den, f"{path}/frequencies").write.option("compression", "zstd").parquet(f"{path}/sets")
    # Columns apart: all rows without their n-grams, and the n-grams of each set once.
    sets = spark.read.parquet(f"{path}/sets")
    rows = cut_lineage(sets.drop("tokens", "codes"))
    active = cut_lineage(sets.filter(F.col("tokens").isNotNull()).select("n", "signature", "tokens", "codes").dropDuplicates(["signature"]))
    remove_scratch(spark, path)
    edges = links(active, num, den)
    sets = rows.filter(F.col("signature").isNotNull()).groupBy("signature").agg(F.min("doc_id").alias("least"))
    roots = connected_components(edges).withColumnRenamed("node", "signature")
    sets = sets.join(roots, "signature", "left")
    sets = cut_lineage(sets.withColumn("root", F.coalesce("root", "signature")))
    # Only sets with a link need the smallest id of their component.
    least = sets.groupBy("root").agg(F.min("least").alias("component_id"))
    named = sets.join(least, "root").select("signature", "component_id", F.col("root").alias("component"))
    out = rows.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "signature").join(named, "signature", "left")
    alone = F.when(F.col("signature").isNull(), F.col("doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", F.coalesce("component_id", alone).alias("component_id"), "component")
