"""The key sieve, and the joins that use it, against brute force."""

import random

from pyspark.sql import functions as F

from corroborate.operators import sieve
from corroborate.operators import similarity as Y


def test_no_wanted_key_is_lost_whatever_its_type(spark):
    keys = spark.createDataFrame([(i,) for i in range(0, 900, 3)] + [(None,), (3,)], "k int")
    rows = spark.createDataFrame([(i, f"row {i}") for i in range(900)] + [(None, "no key")], "id bigint, text string")
    got = [r.id for r in sieve.keep_wanted(rows, F.col("id"), keys, F.col("k")).collect()]
    assert set(range(0, 900, 3)) <= set(got) and len(got) == len(set(got)) and None not in got
    assert len(got) < 320


def test_empty_sides_and_columns_with_other_names(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, word int")
    none = spark.createDataFrame([], "k string")
    assert sieve.keep_wanted(rows, F.col("k"), none, F.col("k")).count() == 0
    one = sieve.keep_wanted(rows, F.col("k"), rows.filter("k = 'b'"), F.col("k"))
    assert one.columns == ["k", "word"] and [tuple(r) for r in one.collect()] == [("b", 2)]
    assert sieve.keep_wanted(rows.limit(0), F.col("k"), rows, F.col("k")).count() == 0


def test_the_set_is_bounded_and_the_table_does_not_move(spark):
    keys = spark.range(400_000)
    bits = sieve.bit_set(keys, F.col("id"))
    assert bits.count() <= sieve.WORDS
    plan = sieve.sift(spark.range(1000), F.col("id"), bits)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def likeness(a, b):
    i = len(a & b)
    return max(i / len(a | b), i / min(len(a), len(b)) * 0.9) if a and b else 0.0


def test_best_match_over_rounds_equals_all_pairs(spark):
    rng = random.Random(23)
    words = [f"t{i}" for i in range(300)]
    sets = {}
    for i in range(240):
        if i % 3 == 0 or i < 20:
            sets[i] = frozenset(rng.sample(words, rng.choice([1, 2, 4, 30, 80])))
        else:
            near = set(sets[rng.randrange(20)] if i % 2 else sets[rng.choice(sorted(sets))])
            for _ in range(rng.randrange(8)):
                near ^= {rng.choice(words)}
            sets[i] = frozenset(near)
    rows = [(i, None if i % 17 == 0 else "x" if i % 5 else "y", sorted(s)) for i, s in sets.items()]
    rows += [(1000 + i, "x", rows[1][2]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, block string, tokens array<string>")
    found = Y.best_duplicate(df.filter("id % 2 = 1"), df.filter("id % 2 = 0"), 0.6).collect()
    got = {r.candidate_id: (r.match_id, round(r.score, 9)) for r in found}
    assert len(got) == len(found)
    want = {}
    for i, block, tokens in rows:
        options = [
            (-likeness(set(tokens), set(other)), j)
            for j, b, other in rows
            if i % 2 and j % 2 == 0 and block is not None and b == block and likeness(set(tokens), set(other)) >= 0.6
        ]
        if options:
            score, j = min(options)
            want[i] = (j, round(-score, 9))
    assert got == want and any(s < 0.9 for _, s in want.values()) and any(0.9 < s < 1 for _, s in want.values())


def test_recurring_phrases_equal_counting_by_hand(spark):
    from corroborate.operators import reports

    rng = random.Random(4)
    words = ["a", "b", "c", "d"]
    texts = [(None if i == 3 else f"t{i % 3}", " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 9, 14])))) for i in range(90)]
    texts += [("t0", None), ("t9", "q r s"), ("t9", "q r s")]
    known = [("a b c",), ("d d",), (None,)]
    grams = lambda s: [" ".join(s.split()[i : i + 3]) for i in range(len((s or "").split()) - 2)]
    seen, where = {}, {}
    for topic, text in texts:
        for g in grams(text) if text else []:
            seen[g] = seen.get(g, 0) + 1
            where.setdefault(g, set()).add(topic)
    want = {(g, len(t), seen[g]) for g, t in where.items() if len(t) >= 2 and g != "a b c"}
    got = reports.uncovered_phrases(
        spark.createDataFrame(texts, "topic_id string, text string"), spark.createDataFrame(known, "text string"), 3, 2
    ).collect()
    assert {(r.phrase, r.topics, r.occurrences) for r in got} == want and len(got) == len(want) > 5


def test_phrases_over_many_flushes_and_shards_spell_only_what_recurs(spark, monkeypatch):
    from corroborate.operators import phrases as P

    monkeypatch.setattr(P, "FLUSH", 50)
    monkeypatch.setattr(P, "SHARD_BYTES", 300)
    rng = random.Random(6)
    texts = [(None if i % 5 == 0 else f"t{i % 5}", " ".join(rng.choices("abcdefgh", k=rng.choice([0, 1, 2, 30])))) for i in range(60)]
    df = spark.createDataFrame(texts, "topic_id string, text string")
    where, count = {}, {}
    for topic, text in texts:
        w = text.split()
        for i in range(len(w) - 2):
            g = " ".join(w[i : i + 3])
            where.setdefault(g, set()).add(topic)
            count[topic, g] = count.get((topic, g), 0) + 1
    for least in (1, 2, 3):
        wanted = P.recurring(df, 3, least)
        want = {k: n for k, n in count.items() if len(where[k[1]]) >= least}
        got = {(r.topic_id, r.phrase): r["count"] for r in P.spelled(df, 3, wanted).groupBy("topic_id", "phrase").count().collect()}
        # The set has room to spare: no other n-gram is spelled.
        assert got == want and len(wanted) == P.WORDS
