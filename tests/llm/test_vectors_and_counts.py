"""Hard negatives, product codes and token counts against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from corroborate.llm import hard_negatives as H
from corroborate.llm.ball_kmeans import Codebook, digest, learn_and_assign
from corroborate.llm.bpe_count import Counter, count_tokens
from corroborate.llm.queries import QUERIES, tokenizer_path

from .conftest import ROWS

WORD = tokenizer_path("word_bpe_49k.json")
VECTORS = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("row", T.StringType()), T.StructField("score", T.StringType())]
)


def rows_with_every_case(n=420, width=16):
    """Clusters, ties, repeated rows and ids, and rows that take no part."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((4, width))
    rows = []
    for i in range(n):
        x = np.round(centres[i % 4] + 0.7 * rng.standard_normal(width), 1)  # rounded, so scores tie
        rows.append((i, [float(v) for v in x.astype(np.float32)], int(rng.integers(0, 3)), "r", "s"))
    rows += [rows[7], rows[100], rows[100], (None, rows[3][1], 1, None, None), (33, rows[150][1], 2, None, None)]
    bad = [None, [], [None] * width, [float("nan")] + [0.0] * (width - 1), [float("inf")] * width, [float("-inf")] + [0.0] * (width - 1)]
    rows += [(1000 + i, v, 1, None, None) for i, v in enumerate(bad)]
    rows += [(2000, rows[5][1], None, None, None), (2100, [0.5] * (width - 3), 1, None, None)]
    rows += [(3000 + i, rows[11][1], i % 2, None, None) for i in range(60)]  # copies of one vector
    return rows


def whole(x, width):
    return np.array([int(np.floor(256 * float(v))) for v in x] + [0] * (width - len(x)), np.int64)


def usable(x):
    return x is not None and all(v is not None and np.isfinite(v) for v in x)


def mined(rows, every=100, positives=5, negatives=10):
    width = max((len(x) for _, x, *_ in rows if usable(x)), default=1)
    kept = [(i, whole(x, width), label) for i, x, label, *_ in rows if usable(x) and label is not None]
    late = lambda i: (i is None, i)
    out = []
    for a, (i, x, label) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = [(int(x @ y), j, own) for b, (j, y, own) in enumerate(kept) if b != a]
        scored.sort(key=lambda s: (-s[0], late(s[1])))
        for p, pos, _ in [s for s in scored if s[2] == label][:positives]:
            band = [s for s in scored if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p][:negatives]
            out += [(i, pos, r, neg, p, s) for r, (s, neg, _) in enumerate(band, 1)]
    return out


def by_value(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("values", [1 << 19, 600])
def test_hard_negatives_are_those_of_brute_force(spark, monkeypatch, values):
    monkeypatch.setattr(H, "SLOT_VALUES", values)  # one slot, or many
    rows = rows_with_every_case()
    found = H.mine(spark.createDataFrame(rows, VECTORS).repartition(3), every=20).collect()
    want = mined(rows, every=20)
    assert len(want) > 100
    assert by_value(found) == by_value(want)


def test_hard_negatives_of_nothing(spark):
    assert H.mine(spark.createDataFrame([], VECTORS)).collect() == []
    assert H.mine(spark.createDataFrame([(100, [1.0], 1, "", ""), (101, None, 1, "", ""), (100, [1.0], None, "", "")], VECTORS)).collect() == []


def test_intervals_hold_every_product_and_leave_most_out():
    rng = np.random.default_rng(2)
    width = 70  # not a multiple of a word
    rows, anchors = rng.integers(-300, 300, (3000, width)), rng.integers(-300, 300, (9, width))
    rows[5] = 0
    turns = H.rotations(width)
    codes, asked = H.Codes(rows, turns), H.Asked(anchors, turns)
    product = anchors @ rows.T
    cap = np.sort(product, axis=1)
    least, most = cap[:, -20].astype(float), cap[:, -4].astype(float)
    a, b = H.surviving(asked, codes, width, np.arange(9), np.arange(3000), least, most)
    kept = set(zip(a.tolist(), b.tolist()))
    inside = set(zip(*(i.tolist() for i in np.nonzero((product >= least[:, None]) & (product <= most[:, None])))))
    assert inside <= kept
    assert len(kept) < 0.5 * product.size


def coded(rows, parts=16, entries=64, rounds=2):
    width = max((len(x) for _, x, *_ in rows if usable(x)), default=1)
    width = -(-width // parts) * parts
    kept = [(i, label, whole(x, width)) for i, x, label, *_ in rows if usable(x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2].tolist()))
    cut = lambda x: x.reshape(parts, -1)
    books = [[cut(x)[p] for _, _, x in kept[:entries]] for p in range(parts)]

    def nearest(x, p):
        d = [int(((x - e) ** 2).sum()) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        members = defaultdict(list)
        for _, _, x in kept:
            for p in range(parts):
                members[p, nearest(cut(x)[p], p)[0]].append(cut(x)[p])
        for (p, e), xs in members.items():
            books[p][e] = np.array([sum(int(x[i]) for x in xs) // len(xs) for i in range(len(xs[0]))])
    out = []
    for i, label, x in kept:
        best = [nearest(cut(x)[p], p) for p in range(parts)]
        out.append((i, label, bytes(e for e, _ in best), sum(d for _, d in best)))
    return out, np.array(books)


@pytest.mark.parametrize(("width", "parts", "entries"), [(16, 4, 12), (15, 16, 64)])
def test_codes_are_those_of_full_comparison(spark, width, parts, entries):
    rows = rows_with_every_case(200, width)
    made, books = learn_and_assign(spark.createDataFrame(rows, VECTORS).repartition(3), parts, entries, rounds=3)
    want, want_books = coded(rows, parts, entries, rounds=3)
    assert by_value((r.vec_id, r.label, bytes(r.codes), r.error) for r in made.collect()) == by_value(want)
    assert digest(books) == digest(want_books)


def test_codes_of_nothing_and_of_few(spark):
    made, books = learn_and_assign(spark.createDataFrame([(1, None, 1, "", ""), (2, [], 1, "", "")][:1], VECTORS))
    assert made.collect() == [] and books.size == 0
    made, books = learn_and_assign(spark.createDataFrame([(1, [0.5] * 16, 1, "", ""), (1, [0.5] * 16, None, "", "")], VECTORS))
    assert [(r.vec_id, r.error) for r in made.collect()] == [(1, 0), (1, 0)]


def test_balls_give_the_entries_of_full_comparison_with_less_work():
    rng = np.random.default_rng(0)
    for trial in range(60):
        k, d, n, m = (int(rng.integers(1, top)) for top in (65, 6, 400, 40))
        e, x = rng.integers(-m, m + 1, (k, d)), rng.integers(-m, m + 1, (n, d))
        apart = ((x[:, None] - e[None]) ** 2).sum(axis=2)
        best = apart.argmin(axis=1)
        held = np.where(rng.random(n) < 0.8, best, rng.integers(0, k, n)) if trial % 2 else np.zeros(n, np.int64)
        radius2 = np.zeros(k, np.int64)
        np.maximum.at(radius2, held, apart[np.arange(n), held])
        code, distance, _ = Codebook(e, radius2).assign(x, held)
        assert (code == best).all() and (distance == apart.min(axis=1)).all()
    spread = rng.integers(-10_000, 10_000, (64, 4))
    x = spread[rng.integers(0, 64, 5000)] + rng.integers(-300, 300, (5000, 4))
    apart = ((x[:, None] - spread[None]) ** 2).sum(axis=2)
    _, _, work = Codebook(spread, np.full(64, 4 * 300**2)).assign(x, apart.argmin(axis=1))
    assert work < 0.05 * apart.size  # stable cores


def test_large_components_stay_exact():
    e = np.array([[1 << 27, 0], [-(1 << 27), 1]])
    x = np.array([[1, 5], [-1, 5], [0, 0]])
    code, distance, _ = Codebook(e, np.full(2, 1 << 60)).assign(x, np.zeros(3, np.int64))
    want = ((x[:, None] - e[None]) ** 2).sum(axis=2)
    assert code.tolist() == want.argmin(axis=1).tolist() and distance.tolist() == want.min(axis=1).tolist()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


def test_counts_are_those_of_the_library(library):
    rng = random.Random(1)
    odd = ["", "  a", "é　 y  z  ", "don't we'll  <|endoftext|> q", "<|ENDOFTEXT|>.x", "<|startoftext|><|endoftext|>", "A\tB\r\n", "x́ ́y Σ ΑΣ İ ẞ", "日本語 テキスト。 123", "\u0085 \u0085", "\x1c\x1d a\x1fb\x00", "ﬁ Å ½²", "a" * 5000, "ab" * 70_000, "<|endoftext|>" * 3 + "b <|", "x ́ ̀́y", "word " * 40_000]
    letters = "ab'sré \t<|>endoftxΣσ1২३ⅷ_ABĲǅ́日\x1f "
    odd += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    odd += [r[1] or "" for r in ROWS]
    own = Counter(WORD)
    for _ in range(2):  # again, now from the memo
        assert [own.of_text(t) for t in odd] == [len(e.ids) for e in library.encode_batch(odd, add_special_tokens=False)]


def test_a_full_memo_changes_nothing(library, monkeypatch):
    from corroborate.llm import bpe_count

    monkeypatch.setattr(bpe_count, "MEMO_PIECES", 3)
    own = Counter(WORD)
    texts = ["one two three four five six seven", "one eight nine ten two one"] * 2
    assert [own.of_text(t) for t in texts] == [len(library.encode(t).ids) for t in texts]
    assert len(own.memo) <= 3 and len(own.older) <= 3


def test_count_tokens(docs, empty, library):
    found = count_tokens(docs, WORD, limit=20).collect()
    want = []
    for doc_id, text, *_ in ROWS:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 20))
    assert by_value(found) == by_value(want)
    assert count_tokens(empty, WORD).collect() == []


def test_registered_counts_on_whole_documents(spark, library):
    from conftest import SF

    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op13_heap_bpe_counts"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    encoded = library.encode_batch([d.text for d in docs], add_special_tokens=False)
    assert found == {d.doc_id: (len(d.text.encode()), len(e.ids), len(e.ids) > 2048) for d, e in zip(docs, encoded)}
