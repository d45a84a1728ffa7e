import unicodedata

import pytest
from pyspark.sql import functions as F

from corroborate.functions import arrow
from corroborate.functions import scalars as S
from corroborate.functions import text as X


def values(spark, rows, col, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(col).collect()]


def test_doi_forms_agree(spark):
    got = values(spark, ["https://doi.org/10.1000/ABC", "DOI:10.1000/abc", "11.1/x", None], X.norm_doi(F.col("x")))
    assert got == ["10.1000/abc", "10.1000/abc", None, None]


def test_titles_agree_across_accents_and_punctuation(spark):
    rows = [("Café—Choice: A Study",), ("cafe choice a study",)]
    df = spark.createDataFrame(rows, "t string")
    ident = S.record_identity(F.lit(None).cast("string"), F.col("t"), F.lit(2024))
    ids = [r[0] for r in df.select(S.record_id(ident)).collect()]
    assert ids[0] == ids[1] and ids[0].startswith("cr_") and len(ids[0]) == 27


SAMPLES = [
    "plain text", "ﬁnding ﬂow", "a b", "2010–2020", "Été déjà", "⅓ of them", "été",
    "① first", "ＡＢＣ", "naïve—yes", "x²+y³", "", "  ", "...", "Å unit", "Straße",
]


def reference_norm(value):
    folded = unicodedata.normalize("NFKC", value).lower()
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in folded).split())


def test_norm_quality_equals_whole_string_nfkc(spark):
    assert values(spark, SAMPLES, X.norm_quality(F.col("x"))) == [reference_norm(s) for s in SAMPLES]


@pytest.mark.parametrize("needle,occurrence,expected", [("memory limits", 0, (4, 17)), ("memory limits", 1, (24, 38)), ("memory limits", 2, None)])
def test_occurrences(needle, occurrence, expected):
    text = "The memory limits, and  Memory  limits."
    assert arrow.occurrence_span(text, needle, occurrence) == expected


def test_inner_offsets_with_folding_characters():
    text = "café ﬁnding ① here"
    start, end = arrow.occurrence_span(text, "finding 1 here", 0)
    assert text[start:end] == "ﬁnding ① here"


def test_regex_boundaries_are_ascii(spark):
    got = values(spark, ["écritx", "crit", "a crit.", "acrit"], X.matches(F.col("x"), r"\bcrit"))
    assert got == [True, True, True, False]


def test_any_of_equals_separate_patterns(spark):
    from corroborate.functions import vocabulary as V

    texts = [
        "did not replicate", "fails to generalise", "a critique", "no evidence of harm", "reverse-engineering", "reversed effect", "p-hacking", "calm prose",
        "the opposite pattern", "were not found", "only a very weak effect", "contradicted", "effect has disappeared",
    ]
    for markers in (V.DISSENT_MARKERS, V.REVERSAL_MARKERS):
        one = values(spark, texts, F.col("x").rlike(X.any_of([p for _, p in markers])))
        each = [values(spark, texts, X.matches(F.col("x"), p)) for _, p in markers]
        assert one == [any(column[i] for column in each) for i in range(len(texts))]


def test_visible_text(spark):
    html = "<p>a&amp;lt;b</p><script>x<y</script><!-- no -->c&#233;&#x41; &unknown; <b>d</b>"
    assert values(spark, [html], X.visible_text(F.col("x"))) == ["a&lt;b céA &unknown; d"]


def test_trigger_action(spark):
    got = values(spark, ["Show {n} hints only after three visits", "Show hints"], X.trigger_action(F.col("x")))
    assert (got[0].action.split(), got[0].trigger.split()) == (["Show", "hints"], ["only", "after", "visits"])
    assert (got[1].action, got[1].trigger) == ("Show hints", "")


def test_longest_prefix_and_divergence(spark):
    df = spark.createDataFrame([("the quick fox", "quick dog"), ("abc", "abd"), ("abc", "")], "h string, n string")
    got = df.select(X.longest_contained_prefix(F.col("h"), F.col("n")), X.first_divergence(F.col("h"), F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(6, 0), (2, 2), (0, 0)]


def test_first_sentence(spark):
    assert values(spark, ["One. Two.", "No end", "Mr.X went. Then"], X.first_sentence(F.col("x"))) == ["One.", "No end", "Mr.X went."]


def test_content_words(spark):
    got = values(spark, ["These effects and the effect of GLASS studies"], X.content_words(F.col("x")))
    assert sorted(got[0]) == ["effect", "glass"]


def test_counters_round_trip(spark):
    got = values(spark, ["a=3 b=x c=0 d=e=4"], S.format_counters(S.known_counters(F.col("x"), ["a", "b", "c", "d=e"])))
    assert got == ["a=3 d=e=4"]


def test_markers_are_guarded_by_what_they_open_with(spark):
    from corroborate.functions import vocabulary as V
    from corroborate.operators import classify as C

    assert X.opening_words(r"\bnull (?:result|effect)\b|\bcalls?\b") == ["null ", "call"]
    assert X.opening_words(r"\bre-?examin") is None and X.opening_words(r"(?:a|b) c") is None
    texts = ["NULL Findings of a ReAppraisal", "Criticue, critique", "Overestimated and inflated estimate", "It does not hold; nonull result", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.array_compact(F.array(*[F.when(X.matches(F.col("t"), p), F.lit(n)) for n, p in V.DISSENT_MARKERS]))
    rows = df.select(C.fired_markers(F.col("t")).alias("a"), plain.alias("b")).collect()
    assert all(r.a == r.b for r in rows) and sum(len(r.a) for r in rows) >= 4


def test_word_forms_reach_every_content_word(spark):
    text = "Markers marker glass glasses this Results result; buses étés class lens"
    row = spark.createDataFrame([(text,)], "t string").select(
        X.content_words(F.col("t")).alias("c"),
        F.array_intersect(X.raw_words(F.col("t")), X.word_forms(X.content_words(F.col("t")))).alias("met"),
    ).first()
    # Whatever content word two texts share, one of its forms stands among the raw words.
    for word in row.c:
        assert {word, word + "s"} & set(row.met)
    assert {"markers", "marker", "results", "result"} <= set(row.met)
