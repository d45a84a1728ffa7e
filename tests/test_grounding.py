import random

import pytest
from pyspark.sql import functions as F

from corroborate.functions import text as X
from corroborate.functions import vocabulary as V
from corroborate.operators import grounding as G
from corroborate.operators import skew


def brute_norm(text):
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split())


def test_find_passages_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(3, 60))) + rng.choice(["", ".", " été"])) for i in range(80)]
    passages = []
    for p in range(40):
        body = docs[rng.randrange(80)][1]
        start = rng.randrange(max(1, len(body) - 5))
        passages.append((p, body[start : start + rng.choice([2, 4, 9, 25, 80, 150])]))
    passages += [(100, "a"), (101, "..."), (102, passages[0][1]), (103, "never in there at all today")]
    found = G.find_passages(
        spark.createDataFrame(passages, "passage_id int, passage string"), spark.createDataFrame(docs, "doc_id int, text string")
    ).collect()
    got = {(r.passage_id, r.doc_id) for r in found}
    want = {(p, d) for p, q in passages for d, t in docs if brute_norm(q) and brute_norm(q) in brute_norm(t)}
    assert got == want
    texts = dict(docs)
    assert all(texts[r.doc_id][r.start : r.end] == r.quote for r in found)
    needles = dict(passages)
    assert all(brute_norm(r.quote) == brute_norm(needles[r.passage_id]) for r in found)


def test_find_passages_with_hot_keys(spark):
    docs = [(i, "one two three four five six seven eight" if i % 3 else f"doc {i} holds nothing") for i in range(60)]
    found = G.find_passages(
        spark.createDataFrame([(1, "two three four five six seven")], "passage_id int, passage string"),
        spark.createDataFrame(docs, "doc_id int, text string"),
    )
    assert found.count() == sum(1 for i in range(60) if i % 3)


VARIANTS = ["Memory-limits apply", "memory  limits apply", "MEMORY LIMITS APPLY", "memory limits apply", "(memory limits apply)", "memory limits apply.", "memory‐limits apply", "“memory limits apply”"]


def test_tolerated_variants_share_one_span(spark):
    source = "Here: memory limits apply, always."
    quotes = spark.createDataFrame([(i, 1, q) for i, q in enumerate(VARIANTS)], "qid int, record_id int, quote string")
    sources = spark.createDataFrame([(1, source)], "record_id int, source_text string")
    rows = G.ground_quotes(quotes, sources, "qid").collect()
    assert {(r.start, r.end, r.derived) for r in rows} == {(6, 25, "memory limits apply")}


def test_derive_quote(spark):
    df = spark.createDataFrame([(0, 5), (0, 999), (5, 5), (-1, 4), (5, 6)], "s int, e int")
    got = [r[0] for r in df.select(G.derive_quote(F.lit("Seven words"), F.col("s"), F.col("e"))).collect()]
    assert got == ["Seven", None, None, None, None]


POSITIVE = [
    ("The effect was reversed", "reverse"), ("An opposite pattern", "opposite"), ("contrary to our view", "contrary-to"), ("It failed to replicate", "fail-to+verb"),
    ("It did not hold", "neg+claim-verb"), ("It does not improve", "neg+outcome-verb"), ("was not observed", "was-not+participle"), ("no reliable difference", "no-significant"),
    ("no effect of load", "no-effect-of"), ("no evidence that", "no-evidence"), ("little support for", "no-support-for"), ("a null result", "null-result"),
    ("absence of an effect", "absence-of"), ("this refutes it", "contradicts"), ("the benefit then disappeared", "effect-disappeared"), ("only a small gain", "only-a-weak"),
]
NEGATIVE = ["as opposed to reading", "however, it held", "reverse-engineering the tool", "it did not rain", "notably found", "adverse events"]


def test_reversal_markers(spark):
    df = spark.createDataFrame([(t,) for t, _ in POSITIVE] + [(t,) for t in NEGATIVE], "x string")
    got = [r[0] for r in df.select(G.first_marker(F.col("x"), V.REVERSAL_MARKERS)).collect()]
    assert got == [name for _, name in POSITIVE] + [None] * len(NEGATIVE)


@pytest.mark.parametrize(
    "tail,expected",
    [(" Contrary to the modality effect, spoken learning text was worse.", True), (" Contrary to weather reports it rained.", False), (" It held again for modality effect learning text.", False)],
)
def test_contradiction_needs_topic_and_marker(spark, tail, expected):
    quote = "The modality effect improves learning from spoken text."
    df = spark.createDataFrame([(quote + tail, quote)], "s string, q string")
    got = df.select(G.contradiction(F.col("s"), F.length("q"), F.col("q")).alias("c")).first().c
    assert (got is not None) == expected


def test_sections_need_two_known_labels(spark):
    texts = ["Background: a b. Results: c d. Note: e.", "Conclusion: only one.", "Nothing here"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [[(s.label, s.at) for s in r[0] or []] for r in df.select(G.sections(F.col("x"))).collect()]
    assert got == [[("Background", 0), ("Results", 17)], [], []]


def test_locate_all_udtf(spark):
    from corroborate.functions.arrow import LocateAll

    rows = LocateAll(F.lit("ab ab, AB"), F.lit("ab")).collect()
    assert [(r.occurrence, r.start, r.end) for r in rows] == [(0, 0, 2), (1, 3, 5), (2, 7, 9)]


def test_find_passages_of_every_length_cut_inside_words(spark):
    rng = random.Random(12)
    words = ["memory", "load", "über", "x", "naïve", "7", "limits", "of", "Ⅷ", "apply"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 5, 40])))) for i in range(60)] + [(60, None), (61, "limits " * 3000)]
    passages = [(0, None), (1, ""), (2, "load"), (3, "ory lo"), (4, "limits limits limits lim")]
    for p in range(5, 60):
        body = docs[rng.randrange(60)][1]
        start = rng.randrange(max(1, len(body)))
        passages.append((p, body[start : start + rng.choice([1, 3, 7, 12, 18, 24, 30, 40, 60, 80])]))
    p, d = spark.createDataFrame(passages, "passage_id int, passage string"), spark.createDataFrame(docs, "doc_id int, text string")
    norm = lambda df, key, col: {r[0]: r[1] for r in df.select(key, X.norm_quality(F.col(col))).collect()}
    needles, hays = norm(p, "passage_id", "passage"), norm(d, "doc_id", "text")
    want = {(i, j) for i, n in needles.items() for j, h in hays.items() if n and h and n in h}
    found = G.find_passages(p, d).collect()
    assert {(r.passage_id, r.doc_id) for r in found} == want and len(found) == len(want)
    assert {len(needles[i].split()) for i, _ in want} >= {1, 2, 3, 4, 5, 6, 7}


def test_quotes_of_unknown_and_null_records_stay_rows(spark):
    quotes = spark.createDataFrame([(1, 5, "two three"), (2, 9, "two"), (3, None, "two")], "qid int, record_id int, quote string")
    sources = spark.createDataFrame([(5, "one two three"), (6, "two three"), (None, "two")], "record_id bigint, source_text string")
    rows = {r.qid: (r.start, r.end) for r in G.ground_quotes(quotes, sources, "qid").collect()}
    assert rows == {1: (4, 13), 2: (None, None), 3: (None, None)}


def test_citations_that_ask_the_same_are_judged_once(spark):
    quotes = ["Plain words here", "“Plain  words here”", "plain words HERE.", "absent words", None]
    roles = ["finding", "finding", None, "finding", "finding"]
    rows = [(f"i{n}-{k}", 0, f"r{n}", quotes[k], roles[k], None, None, "d", "t", "x", None) for n in range(3) for k in range(5)]
    names = "item_id string, pos int, record_id string, quote string, span_role string, start bigint, end bigint, doi string, title string, topic_id string, source_sha256 string"
    cites = spark.createDataFrame(rows, names)
    records = spark.createDataFrame(
        [(f"r{n}", "Before. Plain words here, and after.", "d", "t", "x") for n in range(2)],
        "record_id string, source_text string, r_doi string, r_title string, r_topic_id string",
    )
    found = {r.item_id: r.reason for r in G.grounding_gate(cites.select("item_id"), cites, records).collect()}
    want = [None, None, "span_role_missing", "quote_not_in_source", "malformed_citation"]
    assert found == {f"i{n}-{k}": want[k] for n in range(2) for k in range(5)} | {
        f"i2-{k}": "malformed_citation" if quotes[k] is None else "unknown_record_id" for k in range(5)
    }
    asked = cites.withColumn("needle", X.norm_quality(F.col("quote"))).filter("quote IS NOT NULL")
    # Of four citations a record, three ask the same needle, two of these with one role.
    assert G._judged_texts(asked, records, True).count() == 2 * 3
