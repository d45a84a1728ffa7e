import itertools
import random

import pytest
from pyspark.sql import functions as F

from corroborate.operators import constraints as P
from corroborate.operators import entity as E
from corroborate.operators import novelty as L
from corroborate.operators import planning as N
from corroborate.operators import similarity as Y
from corroborate.operators import skew


def components(rows):
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = {}
    for r in rows:
        for at, key in enumerate(r[1:]):
            if key is not None:
                if (at, key) in seen:
                    a, b = find(seen[(at, key)]), find(r[0])
                    parent[max(a, b)] = min(a, b)
                else:
                    seen[(at, key)] = r[0]
    groups = {}
    for r in rows:
        groups.setdefault(find(r[0]), set()).add(r[0])
    return {frozenset(g) for g in groups.values()}


def clusters(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.cluster, set()).add(r.id)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("seed", [1, 2])
def test_resolve_entities_equals_union_find(spark, seed):
    rng = random.Random(seed)
    pick = lambda n: None if rng.random() < 0.4 else f"k{rng.randrange(n)}"
    rows = [(i, pick(60), pick(80), pick(90)) for i in range(150)]
    rows += [(150 + i, f"chain{i}", f"chain{i + 1}x" if i % 2 else f"chain{i}x", None) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, a string, b string, c string")
    assert clusters(E.resolve_entities(df, "id", ["a", "b", "c"])) == components(rows)
    shuffled = df.orderBy(F.rand(3)).repartition(17)
    assert clusters(E.resolve_entities(shuffled, "id", ["a", "b", "c"])) == components(rows)


def test_exact_novelty_counts_bridges(spark):
    # The third row joins two earlier records, so its step takes one away.
    rows = [(1, 1, "a", None), (2, 2, None, "b"), (3, 3, "a", "b"), (4, 3, None, None), (5, 4, "a", "z")]
    df = spark.createDataFrame(rows, "id int, step int, k1 string, k2 string")
    got = {r.step: r.records_added for r in L.exact_added(df, "id", ["k1", "k2"], "step").collect()}
    assert {s: n for s, n in got.items() if n} == {1: 1, 2: 1}
    assert got.get(3, 0) == 0 and got.get(4, 0) == 0


def exact_by_hand(rows, base):
    """Merged records per topic before and after every step, by union-find over all rows so far."""
    out = {}
    for topic in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == topic]
        known = [(r[0], *r[2:]) for r in base if r[1] == topic]
        count = len(components(known))
        for step in sorted({r[2] for r in mine}):
            known += [(r[0], *r[3:]) for r in mine if r[2] == step]
            out[topic, step], count = len(components(known)) - count, len(components(known))
    return out


def test_exact_novelty_by_topic_with_a_base(spark):
    rng = random.Random(5)
    pick = lambda: None if rng.random() < 0.4 else f"k{rng.randrange(25)}"
    topic = lambda: rng.choice(["a", "b", "", None])
    base = [(f"b{i}", topic(), pick(), pick()) for i in range(30)]
    rows = [(f"r{i}", topic(), rng.randrange(1, 6), pick(), pick()) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, topic string, step int, k1 string, k2 string")
    known = spark.createDataFrame(base, "id string, topic string, k1 string, k2 string")
    got = L.exact_added(df, "id", ["k1", "k2"], "step", "topic", known).collect()
    assert {(r.topic, r.step): r.records_added for r in got} == exact_by_hand(rows, base)
    empty = L.exact_added(df.limit(0), "id", ["k1", "k2"], "step", "topic", known)
    assert empty.collect() == [] and empty.columns == ["topic", "step", "records_added"]


def test_rolling_and_saturation(spark):
    rates = [0.04] + [0.01] * 9
    rows = [("t", i + 1, r) for i, r in enumerate(rates)]
    df = spark.createDataFrame(rows, "topic_id string, step int, novelty_rate double")
    rolled = L.rolling_mean(df, ["topic_id"], "step", "novelty_rate", "rolling_rate", 10)
    assert [r.rolling_rate for r in rolled.orderBy("step").collect()] == [None] * 9 + [0.013]
    assert L.saturation_point(rolled, 11, 0.05).first().stop_step is None
    assert L.saturation_point(rolled, 10, 0.05).first().stop_step == 10


def test_field_estimate(spark):
    queries = spark.createDataFrame([("s1", 100), ("s2", 200), ("s3", None)], "scope string, total int")
    hits = spark.createDataFrame([("s1", "A"), ("s1", "B"), ("s2", "B"), ("s2", "C"), ("s3", "D")], "scope string, cluster string")
    corpus = spark.createDataFrame([(3,)], "corpus int")
    got = L.field_estimate(queries, hits, corpus).first()
    assert (got.estimate, got.multiplicity, got.measured_scopes) == (225, 1.3333, 2)


@pytest.mark.parametrize("known,low", [(8, False), (9, True)])
def test_low_novelty_is_strict(spark, known, low):
    current = spark.createDataFrame([(i, f"k{i}") for i in range(10)], "id int, k string")
    previous = spark.createDataFrame([(f"k{i}",) for i in range(known)], "k string")
    assert L.novelty_report(current, previous, "id", ["k"]).first().low_novelty is low
    assert L.novelty_report(current, None, "id", ["k"]).first().novelty_rate == 1.0


def similarity(a, b):
    i = len(a & b)
    return max(i / len(a | b), i / min(len(a), len(b)) * 0.9) if a and b else 0.0


@pytest.mark.parametrize("threshold", [0.78, 0.5])
def test_similarity_join_equals_all_pairs(spark, threshold):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(25)]
    sets = {}
    for i in range(120):
        base = set(rng.sample(vocabulary, rng.randint(1, 12)))
        if i % 4 == 0 and sets:
            base = set(rng.choice(list(sets.values())))
            if rng.random() < 0.5:
                base ^= {rng.choice(vocabulary)}
        sets[i] = base
    df = spark.createDataFrame([(i, "x" if i % 3 else "y", sorted(s)) for i, s in sets.items()], "id int, block string, tokens array<string>")
    block = lambda i: "x" if i % 3 else "y"
    first = {}
    for i in sorted(sets):
        if sets[i]:
            first.setdefault((block(i), frozenset(sets[i])), i)
    lead = sorted(first.values())
    want = {
        (a, b) for a, b in itertools.combinations(lead, 2) if block(a) == block(b) and similarity(sets[a], sets[b]) >= threshold
    }
    assert {(r.a_id, r.b_id) for r in Y.similar_pairs(df, threshold).collect()} == want
    best = {r.candidate_id: r.match_id for r in Y.best_duplicate(df.filter("id % 2 = 1"), df.filter("id % 2 = 0"), threshold).collect()}
    expected = {}
    for i in sets:
        options = [(-similarity(sets[i], sets[j]), j) for j in sets if i % 2 and j % 2 == 0 and block(i) == block(j) and similarity(sets[i], sets[j]) >= threshold]
        if options:
            expected[i] = min(options)[1]
    assert best == expected


def greedy(costs, cap, per_run):
    left, out = cap, []
    for c in costs:
        action = "defer" if c > left else "skip" if c > per_run else "run"
        left -= c if action == "run" else 0
        out.append(action)
    return out


@pytest.mark.parametrize("places", [2, 1000])
def test_greedy_admission_in_rounds_equals_fold(spark, monkeypatch, places):
    monkeypatch.setattr(N, "PLACES", places)
    rng = random.Random(places)
    rows, want = [], {}
    for key in ("a", "b"):
        costs = [float(rng.randint(1, 40)) for _ in range(25)]
        rows += [(key, f"{key}{i}", i, c, 100.0) for i, c in enumerate(costs)]
        want.update({f"{key}{i}": a for i, a in enumerate(greedy(costs, 100.0, 35))})
    df = spark.createDataFrame(rows, "k string, item string, rank int, cost double, cap double")
    got = {r.item: r.action for r in N.greedy_admission(df, "k", "item", "rank", "cost", "cap", 35).collect()}
    assert got == want


def test_greedy_admission_counts_cents_exactly(spark):
    costs = [0.07, 0.11, 0.34, 0.26, 0.24]
    df = spark.createDataFrame([("a", str(i), i, c, 1.02) for i, c in enumerate(costs)], "k string, item string, rank int, cost double, cap double")
    got = {r.item: r.action for r in N.greedy_admission(df, "k", "item", "rank", "cost", "cap", 35).collect()}
    assert got == dict.fromkeys("01234", "run")


def test_novelty_curve_with_empty_queries_and_a_base(spark):
    from corroborate.operators.novelty import novelty_curve

    hits = spark.createDataFrame([("t", 1, "a"), ("t", 1, "b"), ("t", 3, "b"), ("t", 3, "c")], "topic_id string, query_index int, cluster string")
    issued = spark.createDataFrame([("t", i) for i in (1, 2, 3)], "topic_id string, query_index int")
    base = spark.createDataFrame([("t", "a")], "topic_id string, cluster string")
    rows = novelty_curve(hits, 2, issued, base).orderBy("query_index").collect()
    assert [(r.query_index, r.step, r.returned, r.records_added, r.novelty_rate, r.cumulative_records) for r in rows] == [
        (1, 1, 2, 1, 0.5, 1),
        (2, 2, 0, 0, 0.0, 1),
        (3, 3, 2, 1, 0.5, 2),
    ]
    assert [r.rolling_rate for r in rows] == [None, 0.25, 0.25]


def test_prefix_scan_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1, 5), ("a", 1, 2), (None, 2, 7)], "k string, o int, v int")
    rows = skew.prefix_scan(df, ["k"], [F.col("o")], sums={"s": "v"}).collect()
    assert sorted((r.k or "", r.o, r.rn, r.s) for r in rows) == [("", 1, 1, 5), ("", 2, 2, 12), ("a", 1, 1, 2)]


def test_prefix_scan_is_independent_of_partitions(spark):
    rows = [("hot" if i % 3 else "cold", (i * 37) % 101, i, i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o int, id int, v int")
    one = skew.prefix_scan(df, ["k"], [F.desc("o"), F.asc("id")], sums={"s": "v"}).collect()
    two = skew.prefix_scan(df.repartition(23), ["k"], [F.desc("o"), F.asc("id")], sums={"s": "v"}).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    for key in ("hot", "cold"):
        part = sorted((r for r in one if r.k == key), key=lambda r: r.rn)
        assert [r.rn for r in part] == list(range(1, len(part) + 1))
        total = 0
        for r in part:
            total += r.v
            assert r.s == total


def test_skew_join_equals_join(spark):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(200)], "key string, id int")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), ("none", 4)], "key string, v int")
    for how in ("inner", "left"):
        a = skew.skew_join(left, right, "key", how).select("key", "id", "v")
        b = left.join(right, "key", how).select("key", "id", "v")
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_duplicate_identity_is_reported(spark):
    rows = [("Same", 2020, None), ("same", 2020, None), ("Other", 2020, None)]
    df = spark.createDataFrame(rows, "title string, year int, doi string")
    from corroborate.functions import scalars as S

    ident = df.withColumn("identity", S.record_identity(F.col("doi"), F.col("title"), F.col("year")))
    bad = E.id_violations(ident.withColumn("rid", S.record_id(F.col("identity"))), "identity", "rid").collect()
    assert [(r.violation, r.rows) for r in bad] == [("duplicate_identity", 2)]


def test_coverage_ledger_levels(spark):
    rows = [
        ("T", "evidence", None, None, 1, "processed"), ("T", "evidence", "effects", None, 1, "processed"), ("T", "evidence", "effects", None, 2, "processed"),
        ("T", "evidence", "effects", "e1", 3, "processed"), ("T", "evidence", None, None, 9, "processed"),
    ]
    df = spark.createDataFrame(rows, "topic_id string, kind string, mode string, effect_id string, record_id int, state string")
    known = spark.createDataFrame([("T", 1), ("T", 2), ("T", 3)], "topic_id string, record_id int")
    got = sorted((r.record_id, r.violation) for r in P.coverage_ledger(df, known).collect())
    assert got == [(2, "mode_outside_topic"), (3, "effect_outside_mode"), (9, "unknown_record")]


def test_structural_duplicate_steps_aside_for_itself(spark):
    rows = [("a", "T", "show hints when users stop"), ("b", "T", "show hints when users stop"), ("c", "T", "unrelated words here")]
    df = spark.createDataFrame(rows, "id string, topic_id string, directive string")
    got = {r.candidate_id: r.match_id for r in Y.structural_duplicate(df, df).collect()}
    assert got == {"a": "b", "b": "a"}


def test_structural_duplicate_equals_all_pairs(spark):
    rng = random.Random(4)
    groups = {"g1": ["tip", "hint"], "g2": ["panel"], "g3": ["slow"]}
    words = ["tip", "hint", "panel", "slow", "red", "blue", "green", "box", "line", "dot", "arc"]
    rows = []
    for i in range(40):
        tail = f" when {' '.join(rng.sample(words, rng.randint(1, 3)))}" if rng.random() < 0.6 else ""
        rows.append((f"d{i:02d}", "T", " ".join(rng.sample(words, rng.randint(1, 5))) + tail))
    rows += [(f"e{i}", "T", rows[i][2]) for i in range(5)]

    def parts(text):
        action, mark, trigger = text.partition(" when ")
        sets = [set(action.split()), set(("when " + trigger).split()) if mark else set()]
        return sets, [{g for g, v in groups.items() if s & set(v)} for s in sets], bool(mark)

    def field(a, b, ga, gb):
        share = len(ga & gb) / min(len(ga), len(gb)) if ga and gb else 0.0
        return max(similarity(a, b), share * 0.8)

    def score(x, y):
        (sx, gx, mx), (sy, gy, my) = parts(x), parts(y)
        action = field(sx[0], sy[0], gx[0], gy[0])
        trigger = action if not mx and not my else field(sx[1], sy[1], gx[1], gy[1])
        return min(action, trigger)

    df = spark.createDataFrame(rows, "id string, topic_id string, directive string")
    got = {r.candidate_id: r.match_id for r in Y.structural_duplicate(df, df, groups=groups).collect()}
    want = {}
    for i, _, x in rows:
        options = [(-score(x, y), j) for j, _, y in rows if j != i and score(x, y) >= 0.3]
        if options:
            want[i] = min(options)[1]
    assert got == want


def test_structural_duplicate_by_trigger_words_and_action_groups(spark):
    groups = {"g1": ["tip", "hint"], "g2": ["panel"]}
    old = [("a", "T", "hint box when red line"), ("b", "T", "panel arc when red line"), ("c", "T", "hint arc when blue dot"), ("d", None, "tip when red line")]
    new = [("x", "T", "tip when red line"), ("y", "T", "tip when blue dot"), ("z", "U", "tip when red line"), ("n", None, "tip when red line"), ("m", "T", None)]
    schema = "id string, topic_id string, directive string"
    out = Y.structural_duplicate(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema), groups=groups)
    got = {r.candidate_id: (r.match_id, round(r.score, 4)) for r in out.collect()}
    assert got == {"x": ("a", 0.8), "y": ("c", 0.8)}
