import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corroborate.llm.encode import Encoder
from corroborate.llm.queries import tokenizer_path
from corroborate.llm.sum_of_squares import pack_documents, pack_items, packed_sequences, sum_of_squares
from corroborate.llm.token_store import PerfectHash, read_store, write_store
from corroborate.session import scratch_path

from .conftest import ROWS, frame

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
ODD = ["", "  a", "a  b\n\n c ", "é　 y  z  ", "don't we'll  <|endoftext|> q", "<|ENDOFTEXT|>.x", "A\tB\r\n", " \n", "x́ ́y Σ ΑΣ İ ẞ", "日本語 テキスト。 123 456", "\u0085 \u0085", "end.  next,  word!? a.b"]


def ids_of(path, end, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [end]


@pytest.mark.parametrize(("path", "end", "spaced"), [(WORD, 1, False), (BYTE, 0, True)])
def test_pieces_give_the_ids_of_whole_texts(path, end, spaced):
    texts = ODD + [r[1] for r in ROWS if r[1] is not None]
    made = []
    for _ in range(2):  # again, now from the memo
        made = [ids[a:b].tolist() for _, ids, at in Encoder(path, end, spaced).batches(pa.array(texts)) for a, b in zip(at[:-1], at[1:])]
    assert made == [ids_of(path, end, t) for t in texts]


def test_sum_of_squares_follows_its_rule():
    rng = np.random.default_rng(3)
    sizes, capacity = rng.integers(1, 30, 300), 30
    where, offset, level = sum_of_squares(sizes, capacity)
    levels = []
    for i, size in enumerate(sizes.tolist()):
        def total(bins):
            return sum(n * n for g, n in np.ndenumerate(np.bincount(bins, minlength=capacity + 1)) if 0 < g[0] < capacity)

        options = [(total(levels[:b] + [h + size] + levels[b + 1 :]), -h, b) for b, h in enumerate(levels) if h + size <= capacity]
        options.append((total([*levels, size]), 0, len(levels)))
        least = min(options)
        at = levels[where[i]] if where[i] < len(levels) else 0
        assert (total(levels[: where[i]] + [at + size] + levels[where[i] + 1 :]), -at) == least[:2]
        assert offset[i] == at
        levels[where[i] : where[i] + 1] = [at + size]
    assert levels == level.tolist()


def check_gapless(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pack_documents(docs):
    rows = pack_documents(docs, WORD, capacity=64).collect()
    want = []
    for doc_id, text, *_ in ROWS:
        ids = ids_of(WORD, 1, text)
        for piece, start in enumerate(range(0, len(ids), 64)):
            part = ids[start : start + 64]
            want.append((doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    bins = check_gapless(rows, 64)
    assert bins <= 1.05 * sum(w[3] for w in want) / 64 + 2


def test_packed_sequences_hold_the_ids(spark, docs):
    placed = pack_documents(docs, WORD, capacity=64)
    rows = placed.collect()
    placed = spark.createDataFrame(rows, placed.schema)
    made = {r.sequence_id: r.ids for r in packed_sequences(docs, placed, WORD, capacity=64).collect()}
    for r in rows:
        part = made[r.sequence_id][r.offset : r.offset + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32


def test_packing_in_rounds_places_every_item_once(spark, monkeypatch):
    monkeypatch.setattr("corroborate.llm.sum_of_squares.PIECES_PER_GROUP", 50)
    items = spark.createDataFrame([(i, 1 + (i * 37) % 99) for i in range(1000)], "item long, size long")
    size = dict(items.collect())
    bins = defaultdict(list)
    for r in pack_items(items, 100).collect():
        bins[r.bin].append((r.offset, size[r.item]))
    assert sum(map(len, bins.values())) == 1000
    for parts in bins.values():
        ends = [0, *np.cumsum([s for _, s in sorted(parts)])]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 100
    assert len(bins) <= 1.1 * sum(size.values()) / 100


def test_pack_nothing(empty):
    assert pack_documents(empty, WORD).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 1000, 20_000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        made = PerfectHash.unpack(PerfectHash.build(keys).pack())
        assert sorted(made.find(keys).tolist()) == list(range(len(keys)))
        assert made.find(keys ^ np.uint64(1)).max(initial=-1) < max(len(keys), 1)


def test_store_round_trip(spark, docs, monkeypatch):
    monkeypatch.setattr("corroborate.llm.token_store.SHARD_BYTES", 100_000)
    monkeypatch.setattr("corroborate.llm.token_store.KEYS_PER_INDEX_SHARD", 4)
    path = scratch_path(spark, "store-test")
    write_store(docs, path, BYTE, 0)
    got = [(r.doc_id, r.start, r.ids) for r in read_store(spark, path, docs, with_ids=True).collect()]
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    got.sort(key=lambda r: r[1])
    assert [r[1] for r in got] == np.cumsum([0] + [len(r[2]) for r in got])[:-1].tolist()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((a, c) for a, _, c in got), key=key) == sorted(((r[0], ids_of(BYTE, 0, r[1])) for r in ROWS), key=key)
    ids = [a for a, _, _ in sorted(got, key=lambda r: r[1])]
    assert ids == [r[0] for r in order]
    unknown = spark.createDataFrame([(10,), (77,), (-1,)], "doc_id long")
    assert [r.doc_id for r in read_store(spark, path, unknown).collect()] == [10]


def test_store_of_nothing(spark, empty):
    path = scratch_path(spark, "store-empty")
    write_store(empty, path, BYTE, 0)
    assert read_store(spark, path, frame(spark)).count() == 0
