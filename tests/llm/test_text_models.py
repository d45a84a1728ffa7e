import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from corroborate.llm import bottom_k as B
from corroborate.llm.elias_fano_lm import EliasFano, Trie, score_documents
from corroborate.llm.importance import resample, take_largest
from corroborate.llm.labels import labelled_sample
from corroborate.llm.rank_order import UNKNOWN, identify, learn_profiles
from corroborate.llm.toxic_segments import chance, learn, maximal_segments, passages, score

from .conftest import ROWS, spaced_words


def by_row(rows, *columns):
    return sorted((tuple((v is not None, v) for v in (r[c] for c in columns)) for r in rows))


# Elias-Fano language model


def test_elias_fano_sequence():
    rng = np.random.default_rng(1)
    for n, top in ((1, 5), (10, 1 << 60), (1000, 1 << 64), (5000, 6000), (3, 3), (0, 9), (70_000, 1 << 40)):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        made = EliasFano.encode(values)
        assert (made.get(np.arange(n)) == values).all()
        probes = np.concatenate([values, values + np.uint64(1), rng.integers(0, top, 300, dtype=np.uint64)])
        at, equal = made.successor(probes)
        assert (equal == np.isin(probes, values)).all()
        assert (at == np.searchsorted(values, probes)).all()


def test_trie_finds_what_it_holds():
    rng = np.random.default_rng(2)
    pairs = np.unique(np.stack([rng.integers(0, 40, 2000), rng.integers(0, 90, 2000)]).astype(np.uint64), axis=1)
    log_p = -rng.random(pairs.shape[1]) * 8
    trie = Trie(memoryview(Trie.build(pairs[0], pairs[1], log_p)))
    code = trie.find(pairs[0], pairs[1])
    assert (code > 0).all() and np.abs(trie.book[code] - log_p).max() < 0.1
    absent = np.setdiff1d(np.arange(41 * 91), pairs[0] * np.uint64(91) + pairs[1]).astype(np.uint64)
    assert not trie.find(absent // np.uint64(91), absent % np.uint64(91)).any()


def lm_by_hand(rows, mu):
    """(n_tokens, n_known, train_tokens, base, score) of each row, without quantisation."""
    learn = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 != 2 for r in rows]
    tokens = [[*spaced_words(r[1]), None] for r in rows]
    one, two, start = Counter(), Counter(), 0
    for words, use in zip(tokens, learn):
        if use:
            one.update(words)
            two.update(zip(["<", *words], words))
            start += 1
    n, v = sum(one.values()), len(one)
    discount = 0.95 * (sum(c == 1 for c in one.values()) + 1) / (v + 1)
    single = lambda w: (one[w] - discount if one[w] else discount * v) / n
    out = []
    for words in tokens:
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in words)
        full = 0.0
        for before, w in zip(["<", *words], words):
            c = start if before == "<" else one[before]
            full += math.log10((two[before, w] + mu * single(w)) / (c + mu))
        out.append((len(words), sum(one[w] > 0 for w in words), n, base, full))
    # All outcomes that can follow some word add up to one.
    assert abs(sum((two["the", w] + mu * single(w)) / (one["the"] + mu) for w in [*one, "never seen"]) - 1) < 1e-9
    return out


def test_language_model_against_hand_count(spark, docs, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr("corroborate.llm.elias_fano_lm.SHARD_BYTES", 60_000)
    learn = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).alias("learn")
    got = score_documents(docs.select("doc_id", "text", learn), "learn", mu=3.0).collect()
    want = [(r[0], *w) for r, w in zip(ROWS, lm_by_hand(ROWS, 3.0))]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    for g, w in zip(sorted(map(tuple, got), key=order), sorted(want, key=order), strict=True):
        assert g[:4] == w[:4]
        assert abs(g[4] - w[4]) < 1e-6 * max(1, abs(w[4]))
        assert abs(g[5] - w[5]) < 0.05 + 0.02 * abs(w[5])


def test_language_model_of_nothing(empty):
    assert score_documents(empty.selectExpr("doc_id", "text", "true as learn"), "learn").count() == 0


def test_language_model_without_training_rows(docs):
    rows = score_documents(docs.selectExpr("doc_id", "text", "cast(null as boolean) as learn"), "learn").collect()
    assert len(rows) == len(ROWS) and all(r.score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in rows)


def test_language_model_refuses_other_blocks(spark, tmp_path, monkeypatch):
    """Splits that change between the scans end the run; no block takes the counts of another."""
    from corroborate.llm import elias_fano_lm as E

    path, real = str(tmp_path / "documents.parquet"), E._ask_pairs
    rows = [(i, f"alpha beta w{i % 5} w{i}", True) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(8).write.parquet(path)

    def ask(*args):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        return real(*args)

    monkeypatch.setattr(E, "_ask_pairs", ask)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        docs = spark.read.parquet(path)
        with pytest.raises(Exception, match="not read in the same blocks again"):
            E.score_documents(docs, "learn").collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


# Language profiles


def test_languages(docs):
    profiles = learn_profiles(docs).toPandas()
    assert profiles.groupby("lang").size().max() <= 300
    rows = identify(docs, profiles).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == UNKNOWN) == (not letters)
        assert (r.score == 0) == (not letters) and 0 <= r.score <= 1
        if letters and r.lang in ("en", "fr") and len(r.text) > 30:
            assert r.lang_pred == r.lang


def test_profile_ranks_by_hand(spark):
    texts = ["abab b", "ab"]
    rows = spark.createDataFrame([("x", t) for t in texts], "lang string, text string")
    counts = Counter()
    for t in texts:
        for word in t.split():
            padded = f" {word} "
            counts.update(word)
            counts.update(padded[i : i + 2] for i in range(len(padded) - 1))
    made = learn_profiles(rows, max_n=2).toPandas()
    assert len(made) == len(counts) and sorted(made["rank"]) == list(range(len(counts)))


def test_languages_without_any_training(docs, empty):
    nothing = learn_profiles(empty).toPandas()
    assert {r.lang_pred for r in identify(docs, nothing).collect()} == {UNKNOWN}
    assert identify(empty, nothing).count() == 0


# Bottom-k sketches


def shingle_set(text):
    words = spaced_words(text)
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def test_sketches_estimate_sets():
    rng = random.Random(4)
    a = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    b = a[:2000] + [f"v{i}" for i in range(2000)]
    ta, tb = " ".join(a), " ".join(b)
    sa, sb, small = B.sketches(pa.array([ta, tb, "one two"]), 512, 5)
    sets = shingle_set(ta), shingle_set(tb)
    assert abs(B.resemblance(sa, sb, 512) - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.08
    assert abs(B.containment(sa, sb, 512) - 0.5) < 0.12
    assert abs(B.distinct_count(sa, 512) / len(sets[0]) - 1) < 0.15
    assert B.distinct_count(small, 512) == 1
    assert B.read_sketch(B.write_sketch(sa)).tolist() == sa.tolist()


def test_merged_parts_are_the_sketch_of_all(spark):
    parts = [(k, f"a{i} b{i} c{i} d{i} e{i}") for k in (1, None) for i in range(300)]
    rows = spark.createDataFrame(parts, "key long, text string").repartition(4)
    made = B.merge_parts(B.sketch_documents(rows, k=32), "key", k=32).collect()
    whole = B.merge(B.sketches(pa.array([t for _, t in parts]), 32, 5), 32)
    assert {r.key: r.sketch for r in made} == {1: B.write_sketch(whole), None: B.write_sketch(whole)}


def test_edited_texts(docs, monkeypatch):
    for size in (1 << 20, 1000):
        monkeypatch.setattr(B, "RANGE_BYTES", size)
        got = B.fingerprint_edits(docs).collect()
        assert len(got) == len(ROWS)
        same = {}
        for r in got:
            same.setdefault(r.n_chars, set()).add(r.fingerprint)
        ids = sorted({r[0] for r in ROWS if r[0] is not None})
        texts = {}
        for r in ROWS:
            texts.setdefault(r[0], r[1] or "")
        for r in got:
            if r.doc_id is None or r.doc_id in (2, ids[-1]):
                continue  # ties are ordered by hash; the last one is followed by a null id
            text, after = texts[r.doc_id], texts[ids[ids.index(r.doc_id) + 1]]
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            a, e, n = map(shingle_set, (text, edited, after))
            for value, other in ((r.near_edited, e), (r.near_next, n)):
                exact = len(a & other) / len(a | other) if a | other else 1.0
                assert abs(value - exact) < (1e-9 if len(a | other) < B.K else 0.2)


def test_edits_follow_the_circle(spark):
    rows = spark.createDataFrame([(i, f"text number {i} here") for i in (5, 3, 9)], "doc_id long, text string")
    got = {r.doc_id: r.edited_sha256 for r in B.fingerprint_edits(rows).collect()}
    for i, after in ((3, 5), (5, 9), (9, 3)):
        text = f"text number {i} here"
        half = len(text) // 2
        assert got[i] == hashlib.sha256((text[: len(text) - half] + f"text number {after} here"[:half]).encode()).hexdigest()
    one = spark.createDataFrame([(1, "alone here")], "doc_id long, text string")
    assert B.fingerprint_edits(one).count() == 1


def test_fingerprints_of_nothing(empty):
    assert B.fingerprint_edits(empty).count() == 0


# Importance resampling


def test_take_largest(spark):
    rng = random.Random(6)
    keys = [rng.gauss(0, 1000) for _ in range(500)] + [7.0] * 20
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i long, key double")
    for k in (0, 1, 17, 300, 520, 900):
        got = {r.i for r in take_largest(rows, "key", k).filter("selected").collect()}
        limit = sorted(keys, reverse=True)[k - 1] if 0 < k <= len(keys) else (math.inf if not k else -math.inf)
        assert got == {i for i, v in enumerate(keys) if v >= limit}


def test_resampling_prefers_the_target(spark):
    rng = random.Random(7)
    good = [f"good{i}" for i in range(50)]
    bad = [f"bad{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(60))) for i in range(200)] + [(None, None), (500, "")]
    raw = spark.createDataFrame(rows, "doc_id long, text string")
    made = resample(raw, raw.filter("doc_id % 2 = 1 and doc_id < 40"), 0.4).collect()
    assert len(made) == len(rows)
    chosen = [r for r in made if r.selected]
    assert len(chosen) == round(0.4 * len(rows))
    assert sum(bool(r.text) and "good" in r.text for r in chosen) >= 0.95 * len(chosen)
    assert all(r.log_weight == 0 for r in made if not r.text)


def test_gumbel_top_k_draws_in_proportion(spark):
    """With k = 1 over many seeds each row wins as often as its weight says."""
    from pyspark.sql import functions as F

    from corroborate.llm.importance import importance

    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    wins = 0
    for seed in range(40):
        rows = {r.doc_id: r.gumbel_key - r.log_weight for r in importance(docs, np.zeros(1 << 14), seed).collect()}
        wins += rows[1] + math.log(3) > rows[2]
    assert 20 <= wins <= 39


def test_resampling_nothing(empty):
    assert resample(empty, empty, 0.5).count() == 0


# Toxic segments


def all_segments(weights):
    """Maximal scoring segments by their recursive definition."""

    def split(a, b):
        best = max(((sum(weights[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0, 0))
        if best[0] <= 1e-12:
            return []
        _, _, i, j = best
        return split(a, i) + [(i, j - 1, best[0])] + split(j, b)

    return split(0, len(weights))


def test_maximal_segments():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randrange(1, 25)
        weights = [rng.choice([-0.2, -0.2, rng.random() * 1.3]) for _ in range(n)]
        hits = [i for i, w in enumerate(weights) if w > 0]
        got = maximal_segments(hits, [weights[i] for i in hits], 0.2)
        want = all_segments(weights)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def toxic_rows(n=400):
    rng = random.Random(9)
    calm = [f"calm{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(calm) for _ in range(80)]
        if toxic := i % 8 == 0:
            at = rng.randrange(60)
            words[at : at + 8] = [rng.choice(["vile", "scoundrel", "rotten"]) if j % 2 else rng.choice(calm) for j in range(8)]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame([*rows, (None, None), (900, ""), (901, "vile " * 500)], "doc_id long, text string")
    marked = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = learn(docs, labelled_sample(marked.filter("doc_id % 3 <> 0 or doc_id is null"), "toxic"))
    got = {r.doc_id: r.score for r in score(docs, model).collect()}
    for i, _, toxic in labels:
        if i % 3 == 0:
            assert (got[i] >= 0.3) == bool(toxic)
    assert 0 <= got[900] < 0.3 and 0 <= got[None] < 0.3 and 0 <= got[901] <= 1
    texts = dict(rows)
    found = [r for r in passages(docs, model).collect() if r.doc_id in texts]
    assert {r.doc_id for r in found} >= {i for i, _, t in labels if t}
    assert all(any(w in texts[r.doc_id].encode()[r.start : r.end].decode() for w in ("vile", "scoundrel", "rotten")) for r in found)


def test_repeated_passages_are_all_found_and_dense_ones_keep_their_score(spark):
    rows, labels = toxic_rows()
    model = learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("doc_id", "toxic label"))
    calm = [f"calm{i % 300}" for i in range(900)]
    pairs = [["calm7", "vile"], ["calm8", "rotten"], ["calm9", "scoundrel"], ["calm10", "vile"], ["calm11", "rotten"], ["calm12", "vile"]]
    dense = [word for p in pairs for word in p]
    spread = [word for k, p in enumerate(pairs) for word in [*p, *calm[100 * k : 100 * k + 98]]]
    texts = [(1, calm[:200] + dense + calm[200:400] + dense + calm[400:]), (2, spread + dense), (3, calm[: len(spread)] + dense)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")
    found = [r for r in passages(docs, model).collect() if r.doc_id == 1]
    assert len(found) == 2 and found[0].start != found[1].start
    got = {r.doc_id: r.score for r in score(docs, model).collect()}
    assert got[2] == pytest.approx(got[3]) and got[3] > 0.3


def test_copies_of_one_text_do_not_teach_its_words(spark):
    rows, labels = toxic_rows()
    copies = [(1000 + i, "harmless words that only ever come from one single text " * 3) for i in range(60)]
    docs = spark.createDataFrame(rows + copies, "doc_id long, text string")
    marked = spark.createDataFrame(labels + [(i, 1, int(i % 2 == 0)) for i, _ in copies], "doc_id long, quality int, toxic int")
    model = learn(docs, labelled_sample(marked, "toxic"))
    assert all(r.score < 0.3 for r in score(docs.filter("doc_id >= 1000"), model).collect())


def test_chance_falls_with_score():
    from corroborate.llm.toxic_segments import Model

    model = Model(np.zeros(0, np.uint64), np.zeros(0), 0.1, 1.0, 0.1)
    values = [chance([s], 1000, model) for s in (1, 6, 10, 20)]
    assert values[0] == 1 and values == sorted(values, reverse=True)
    assert chance([8, 8], 1000, model) < chance([8], 1000, model)


def test_toxicity_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = learn(docs, labelled_sample(none, "toxic"))
    assert {r.score for r in score(docs, model).collect()} == {0.0}
    assert score(empty, model).count() == 0


def test_labelled_sample_is_bounded(spark):
    rows = spark.createDataFrame([(i % 50, i % 2) for i in range(200)], "doc_id long, toxic int")
    assert labelled_sample(rows, "toxic", 5, 7).groupBy("label").count().toPandas().set_index("label")["count"].to_dict() == {1: 5, 0: 7}
    assert isinstance(labelled_sample(rows, "toxic").toPandas(), pd.DataFrame)
