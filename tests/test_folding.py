"""Folding inside a batch and admission under two budgets, against one pass in order."""

import random
from decimal import Decimal

import pytest

from corroborate.operators import folding as D
from corroborate.operators import planning as N

CLAIMS = "id long, seq long, kind string, target string, title string, body string, pair string, field string, eligible boolean"
KNOWN = CLAIMS.replace("seq long, ", "").replace("eligible boolean", "status string")


def tokens(text):
    return {w for w in (text or "").lower().split() if len(w) > 1}


def likeness(a, b):
    if not a or not b:
        return 0.0
    shared = len(a & b)
    return max(shared / len(a | b), shared / min(len(a), len(b)) * 0.9)


def similarity(a, b):
    if (a["kind"] or "", a["target"] or "") != (b["kind"] or "", b["target"] or ""):
        return 0.0
    if a["kind"] == "interaction":
        return float(a["pair"] is not None and a["pair"] == b["pair"])
    if a["kind"] == "dossier_section" and (a["field"] or "") != (b["field"] or ""):
        return 0.0
    best = likeness(tokens(a["body"]), tokens(b["body"]))
    if a["kind"] in ("effect", "realization"):
        best = max(best, likeness(tokens(a["title"]), tokens(b["title"])))
    return best


def in_order(batch, known):
    out, admitted = {}, []
    for c in sorted((c for c in batch if c["eligible"]), key=lambda c: (c["seq"], c["id"])):
        old = max(((similarity(c, k), -k["id"], k["status"]) for k in known), default=(0, 0, ""))
        if old[0] >= 0.78:
            out[c["id"]] = (-old[1], old[2])
            if old[2] == "approved":
                admitted.append(c)
            continue
        near = max(((similarity(c, a), -a["id"]) for a in admitted), default=(0, 0))
        if near[0] >= 0.78:
            out[c["id"]] = (-near[1], "pending")
        else:
            admitted.append(c)
    return out


def claim(i, rng, chain=None):
    words = [f"word{w}" for w in range(30)]
    kind = rng.choice(["effect", "realization", "interaction", "dossier_section", "edge", None])
    start = rng.randrange(12)
    return {
        "id": i, "seq": rng.randrange(40), "kind": kind, "target": rng.choice(["x", "y", None]), "title": rng.choice(["", None, "one name", "Two Names here", " ".join(words[:3])]),
        "body": None if rng.random() < 0.1 else " ".join(words[start : start + rng.randint(8, 11)]), "pair": rng.choice(["a__b", "a__c", None]), "field": rng.choice(["dissent", "size", None]), "eligible": rng.random() < 0.9,
    }


def frames(spark, batch, known):
    rows = [tuple(c[n.split()[0]] for n in CLAIMS.split(", ")) for c in batch]
    old = [tuple(k[n.split()[0]] for n in KNOWN.split(", ")) for k in known]
    return spark.createDataFrame(rows, CLAIMS), spark.createDataFrame(old, KNOWN)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_are_those_of_one_pass(spark, seed):
    rng = random.Random(seed)
    batch = [claim(i, rng) for i in range(150)]
    known = [claim(1000 + i, rng) | {"status": rng.choice(["approved", "pending"])} for i in range(12)]
    found = D.match_candidates(*frames(spark, batch, known)).collect()
    want = in_order(batch, known)
    assert len(found) == len(batch) and len(want) > 40
    assert {r.id: (r.match_id, r.match_status) for r in found if r.match_id is not None} == want


def test_a_chain_folds_every_second_link(spark):
    base = {"kind": "edge", "target": "x", "title": None, "pair": None, "field": None, "eligible": True}
    slide = [f"w{i:02}" for i in range(40)]
    batch = [base | {"id": i, "seq": i, "body": " ".join(slide[i : i + 9])} for i in range(9)]  # neighbours share 8 of 10
    found = {r.id: r.match_id for r in D.match_candidates(*frames(spark, batch, [])).collect()}
    assert found == {0: None, 1: 0, 2: None, 3: 2, 4: None, 5: 4, 6: None, 7: 6, 8: None}


def test_a_common_title_folds_onto_its_first_claim(spark):
    base = {"kind": "effect", "target": "x", "title": "the one name", "pair": None, "field": None, "eligible": True}
    batch = [base | {"id": i, "seq": -i, "body": f"body number{i} alone{i}"} for i in range(300)]
    found = {r.id: r.match_id for r in D.match_candidates(*frames(spark, batch, [])).collect()}
    assert found == {i: None if i == 299 else 299 for i in range(300)}


def test_empty_batch(spark):
    assert D.match_candidates(*frames(spark, [], [])).collect() == []


# Admission


QUEUE = "k string, item long, rank long, calls int, records int, usd double, call_cap int, usd_cap double, paused boolean, down boolean"


def admitted(rows, max_calls, max_records):
    out, left = [], {}
    for k, item, rank, calls, records, usd, call_cap, usd_cap, paused, down in sorted(rows, key=lambda r: (r[0] or "", r[2], r[1])):
        if paused or down:
            out.append((k, item, "skip", "paused" if paused else "source_down"))
            continue
        lc, lu = left.setdefault(k, (call_cap if call_cap is not None else 10**18, Decimal(str(usd_cap)) if usd_cap is not None else Decimal(10**18)))
        calls, usd = calls or 0, Decimal(str(usd or 0))
        over = "max_calls_per_run" if calls > max_calls else "max_records_per_run" if (records or 0) > max_records else None
        if calls > lc or usd > lu:
            out.append((k, item, "defer", "monthly_budget"))
        elif over:
            out.append((k, item, "skip", over))
        else:
            left[k] = lc - calls, lu - usd
            out.append((k, item, "run", None))
    return sorted(out, key=str)


@pytest.mark.parametrize("places", [3, 4096])
def test_two_budgets_are_spent_as_in_one_pass(spark, monkeypatch, places):
    monkeypatch.setattr(N, "PLACES", places)
    rng = random.Random(places)
    rows = []
    for k, cap, money in (("a", 300, 90.5), ("b", 40, 1e6), (None, 1000, 7.25), ("c", None, 50.0), ("d", 0, 0.0)):
        for i in range(60):
            calls = rng.choice([0, 1, 3, rng.randint(0, 60), None])
            rows.append((k, i // 2, rng.randrange(8), calls, rng.choice([5, 50, None]), rng.choice([0.0, 0.01, round(rng.random() * 20, 2), None]), cap, money, rng.random() < 0.05, rng.random() < 0.05 or None))
    rows = [r for i, r in enumerate(rows) if (r[0], r[1], r[2]) not in {(q[0], q[1], q[2]) for q in rows[:i]}]
    got = N.admit_queue(spark.createDataFrame(rows, QUEUE), "k", "item", "rank", max_calls=55, max_records=40).collect()
    assert sorted(map(tuple, got), key=str) == admitted(rows, 55, 40)


def test_rounds_grow_with_the_budget_not_with_the_queue(spark, monkeypatch):
    rounds, real = [], N._admit_half
    monkeypatch.setattr(N, "_admit_half", lambda *a: rounds.append(1) or real(*a))
    # Each small run lets one more large task miss the budget by a little.
    rows = [("a", i, i, 1 if i % 2 == 0 else 1000 - i // 2, 0, 0.0, 1000, 0.0, False, False) for i in range(400)]
    got = N.admit_queue(spark.createDataFrame(rows, QUEUE), "k", "item", "rank").collect()
    assert sorted(map(tuple, got), key=str) == admitted(rows, 10**9, 10**9)
    assert len(rounds) <= 11


# Scopes, reading order, collation, rolling means


def test_unknown_and_inactive_scopes_are_refused(spark):
    from corroborate.operators.relational import resolve_scopes

    def table(columns, *rows):
        return spark.createDataFrame(list(rows), columns)

    requests = table("kind string, ident string", ("pack", "p1"), ("pack", "p1"), ("pack", "p9"), ("segment", "s1"), ("segment", "s2"), ("segment", "s9"), ("topic", "1"), ("topic", "9"), ("effect", "e1"), ("effect", "e2"), ("effect", "e9"), ("shelf", "x"), ("topic", None), ("pack", "p3"))
    topics = table("topic_id long", (1,), (2,), (3,))
    packs = table("pack string, topic_id long", ("p1", 1), ("p1", 8), ("p2", 2), ("p3", 8))
    found = resolve_scopes(requests, topics, packs, table("topic_id long", (3,)), table("effect_id string, topic_id long", ("e1", 2), ("e2", 8)), table("segment string, status string", ("s1", "active"), ("s2", "retired")))
    got = sorted(map(tuple, found.collect()), key=str)
    want = [("effect", "e1", 2, None), ("effect", "e2", None, "effect_without_full_topic"), ("effect", "e9", None, "unknown_effect"), ("pack", "p1", 1, None), ("pack", "p1", 3, None), ("pack", "p3", 3, None), ("pack", "p9", None, "unknown_pack"),
            ("segment", "s1", 1, None), ("segment", "s1", 2, None), ("segment", "s1", 3, None), ("segment", "s2", None, "unknown_active_segment"), ("segment", "s9", None, "unknown_active_segment"), ("shelf", "x", None, "unknown_kind"),
            ("topic", "1", 1, None), ("topic", "9", None, "unknown_topic"), ("topic", None, None, "unknown_topic")]
    assert got == sorted(want, key=str)


def test_an_anchor_changes_the_reading_order(spark):
    rows = [("t", "a", 1, 2, 5, 1), ("t", "b", 0, 3, None, 1), ("t", "c", 0, 1, 9, 1), ("t", "d", 0, 1, 50, 1), ("t", "e", None, 0, 99, 1)]
    eligible = spark.createDataFrame(rows, "topic_id string, record_id string, tier int, affinity int, citations int, tokens int")
    terminal = spark.createDataFrame([], "topic_id string, record_id string")

    def order(anchored):
        return [r.record_id for r in N.reading_plan(eligible, terminal, 100, anchored=anchored).orderBy("rn").collect()]

    assert order(False) == ["d", "c", "b", "a"]
    assert order(True) == ["c", "d", "a", "b"]


def test_titles_sort_as_in_a_dictionary(spark):
    from corroborate.operators.reports import collated_positions

    titles = ["zeta", "Éclair", "eclair", "Zebra", "a-b", "ab", "a b", "_x", "1", None, "ab"]
    rows = spark.createDataFrame([(0, i, t) for i, t in enumerate(titles)], "k int, i int, title string")
    got = [r.title for r in collated_positions(rows, ["k"], "title", "i").orderBy("position").collect()]
    assert got == ["_x", "1", "a b", "a-b", "ab", "ab", "eclair", "Éclair", "Zebra", "zeta", None]


@pytest.mark.parametrize("block", [8, 4096])
def test_rolling_means_cross_blocks(spark, monkeypatch, block):
    from corroborate.operators import novelty as L

    monkeypatch.setattr(L, "BLOCK_ROWS", block)
    rng = random.Random(3)
    rates = {k: [rng.randrange(10_000) / 10_000 for _ in range(n)] for k, n in (("a", 100), ("b", 2), ("c", 3))}
    rows = [(k, i, v) for k, vs in rates.items() for i, v in enumerate(vs, 1)]
    got = {(r.k, r.i): r.out for r in L.rolling_mean(spark.createDataFrame(rows, "k string, i long, v double"), ["k"], "i", "v", "out", 3).collect()}
    want = {(k, i): None if i < 3 else int(sum(round(v * 10_000) for v in vs[i - 3 : i]) / 3 + 0.5) / 10_000 for k, vs in rates.items() for i in range(1, len(vs) + 1)}
    assert got == want


def test_a_long_queue_of_small_tasks_takes_few_rounds(spark, monkeypatch):
    rounds, one = [], N._admit_half
    monkeypatch.setattr(N, "_admit_half", lambda *a: rounds.append(1) or one(*a))
    rows = spark.range(3000).selectExpr("'k' AS k", "id AS item", "id AS rank", "1 AS calls", "0 AS records", "2.5 AS usd", "2000 AS call_cap", "9000.0 AS usd_cap", "false AS paused", "false AS down")
    got = N.admit_queue(rows, "k", "item", "rank").groupBy("action").count().collect()
    assert {r.action: r["count"] for r in got} == {"run": 2000, "defer": 1000}
    assert len(rounds) <= 3


def test_pairs_of_sets_travel_as_numbers(spark, monkeypatch):
    seen, plain = [], D.similar_sets
    monkeypatch.setattr(D, "similar_sets", lambda sets, threshold: seen.append(plain(sets, threshold)) or seen[-1])
    rng = random.Random(4)
    D.match_candidates(*frames(spark, [claim(i, rng) for i in range(20)], [])).collect()
    assert [t for _, t in seen[0].dtypes] == ["bigint", "bigint", "double"]
