"""Rule tagging of records: categories, markers, relevance, transferability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions import text as X
from corroborate.functions import vocabulary as V
from corroborate.operators.grounding import any_marker, contradiction, first_marker

Markers = list[tuple[str, str]]


def fired_markers(text: Column, markers: Markers = V.DISSENT_MARKERS) -> Column:
    """Names of all markers that fire, in vocabulary order."""
    def fired(both: Column) -> Column:
        hits = [F.when(X.matches_folded(both["text"], both["lower"], pattern), F.lit(name)) for name, pattern in markers]
        return F.array_compact(F.array(*hits))

    return X.bind(F.struct(text.alias("text"), F.lower(text).alias("lower")), fired)


def is_review_like(title: Column, work_type: Column) -> Column:
    chapter = work_type.isin(V.REVIEW_CHAPTER_TYPES) & X.matches(title, V.REVIEW_CHAPTER_TITLE)
    return (
        F.coalesce(work_type == "review", F.lit(False))
        | X.matches(title, V.META_ANALYSIS_TITLE)
        | F.coalesce(chapter, F.lit(False))
    )


def is_foundational(citations: Column, year: Column, now_year: int) -> Column:
    age = F.lit(now_year) - year
    by_rate = (
        (age >= V.FOUNDATIONAL_AGE)
        & (citations >= V.FOUNDATIONAL_RATE_FLOOR)
        & (citations >= age * V.FOUNDATIONAL_RATE)
    )
    return F.coalesce(citations >= V.FOUNDATIONAL_CITATIONS, F.lit(False)) | F.coalesce(
        by_rate, F.lit(False)
    )


def is_recent(year: Column, now_year: int) -> Column:
    return F.coalesce(year >= now_year - V.RECENT_YEARS, F.lit(False))


def is_topical_review(title: Column, abstract: Column, keywords: Column) -> Column:
    return (
        (F.size(keywords) > 0)
        & F.coalesce(F.length(abstract) > 0, F.lit(False))
        & (X.keyword_hits(title, keywords) >= 1)
        & (X.keyword_hits(F.coalesce(abstract, F.lit("")), keywords) >= 2)
    )


def is_topical_anchor(provider_id: Column, title: Column, abstract: Column, keywords: Column) -> Column:
    n = F.size(keywords)
    return (
        (n > 0)
        & provider_id.isNotNull()
        & F.coalesce(F.length(abstract) > 0, F.lit(False))
        & (X.keyword_hits(title, keywords) >= F.least(F.lit(2), n))
        & (X.keyword_hits(F.coalesce(abstract, F.lit("")), keywords) >= F.least(F.lit(3), n))
    )


def classify(df: DataFrame, now_year: int, dissent: Markers = V.DISSENT_MARKERS) -> DataFrame:
    """Add ``categories``: the tags that apply, in canonical order."""
    joined = F.concat(F.col("title"), F.lit(" "), F.coalesce("abstract", F.lit("")))
    pinned = F.col("pin_reason") if "pin_reason" in df.columns else F.lit(None).cast("string")
    contested = F.concat(joined, F.lit(" "), F.coalesce(pinned, F.lit("")))
    tests = {
        "foundational": is_foundational(F.col("citations"), F.col("year"), now_year),
        "meta-analysis": is_review_like(F.col("title"), F.col("openalex_type")),
        "replication": X.matches(joined, V.REPLICATION),
        "dissent": any_marker(contested, dissent),
        "recent": is_recent(F.col("year"), now_year),
    }
    tags = [F.when(tests[name], F.lit(name)) for name in V.CATEGORIES]
    return df.withColumn("categories", F.array_compact(F.array(*tags)))


def category_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Zero-filled count per category and key; one pass, no explode."""
    counts = [F.count_if(F.array_contains("categories", c)).alias(c) for c in V.CATEGORIES]
    none = F.count_if(F.size("categories") == 0).alias("none")
    grouped = df.groupBy(*keys).agg(*counts, none)
    names = [*V.CATEGORIES, "none"]
    return grouped.unpivot(keys, names, "category", "records")


def retag_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Records whose tags changed, with gained and lost tags (full outer by id)."""
    b = before.select("record_id", "topic_id", F.col("categories").alias("old"))
    a = after.select("record_id", F.col("topic_id").alias("new_topic"), F.col("categories").alias("new"))
    empty = F.array().cast("array<string>")
    joined = b.join(a, "record_id", "full_outer").select(
        "record_id",
        F.coalesce("topic_id", "new_topic").alias("topic_id"),
        F.coalesce("old", empty).alias("old"),
        F.coalesce("new", empty).alias("new"),
    )
    return joined.filter(F.array_sort("old") != F.array_sort("new")).select(
        "record_id",
        "topic_id",
        F.array_except("new", "old").alias("gained"),
        F.array_except("old", "new").alias("lost"),
    )


def marker_impact(df: DataFrame, text: Column, markers: Markers) -> DataFrame:
    """Per marker: records it fires on and records it is the sole reason for."""
    fired = df.select(fired_markers(text, markers).alias("fired"))
    sole = F.size("fired") == 1
    aggs = []
    for i, (name, _) in enumerate(markers):
        on = F.array_contains("fired", name)
        aggs += [F.count_if(on).alias(f"h{i}"), F.count_if(on & sole).alias(f"s{i}")]
    rows = [
        F.struct(F.lit(n).alias("marker"), F.col(f"h{i}").alias("hits"), F.col(f"s{i}").alias("sole"))
        for i, (n, _) in enumerate(markers)
    ]
    return fired.agg(*aggs).select(F.inline(F.array(*rows)))


def marker_coverage(df: DataFrame, vocabularies: dict[str, Markers]) -> DataFrame:
    """Reach of reversal vocabularies after the first sentence of each record.

    One pass over title and abstract computes every vocabulary; a record without
    a second sentence is outside the denominator.
    """
    probe = df.select(X.probe_text(F.col("title"), F.col("abstract")).alias("src")).withColumn(
        "cut", X.first_sentence_end(F.col("src"))
    )
    probe = probe.filter("cut >= 0").select(
        "src",
        "cut",
        F.substring("src", F.lit(1), F.col("cut").cast("int")).alias("quote"),
        F.substring("src", (F.col("cut") + 1).cast("int"), F.length("src")).alias("tail"),
    )
    aggs, rows = [F.count(F.lit(1)).alias("records")], []
    for i, (name, markers) in enumerate(vocabularies.items()):
        found = contradiction(F.col("src"), F.col("cut"), F.col("quote"), markers).isNotNull()
        reached = any_marker(F.col("tail"), markers)
        aggs += [F.count_if(reached).alias(f"r{i}"), F.count_if(reached & found).alias(f"c{i}")]
        rows.append(
            F.struct(
                F.lit(name).alias("vocabulary"),
                F.col("records"),
                F.col(f"r{i}").alias("reached"),
                F.col(f"c{i}").alias("contradictions"),
            )
        )
    return probe.agg(*aggs).select(F.inline(F.array(*rows)))


def first_fires(df: DataFrame, text: Column, markers: Markers) -> DataFrame:
    """How often each marker is the first of its vocabulary to fire."""
    first = df.select(first_marker(text, markers).alias("marker"))
    return first.filter("marker IS NOT NULL").groupBy("marker").agg(F.count(F.lit(1)).alias("first"))


# --- relevance ------------------------------------------------------------------------
def relevance_tier(title: Column, abstract: Column, pinned: Column, keywords: Column) -> Column:
    """0 pinned, 1 title and abstract, 2 either enough or nothing to judge by, null skip."""
    in_title = X.keyword_hits(title, keywords)
    in_abstract = X.keyword_hits(F.coalesce(abstract, F.lit("")), keywords)
    return (
        F.when(pinned, 0)
        .when(F.size(keywords) == 0, 2)
        .when((in_title >= 1) & (in_abstract >= 1), 1)
        .when((in_title >= 1) | (in_abstract >= 2), 2)
    )


def effect_affinity(title: Column, abstract: Column, cited: Column, keywords: Column) -> Column:
    """How closely a record speaks to one effect; 0 is cited by it, 3 is unrelated."""
    in_title = X.keyword_hits(title, keywords)
    in_abstract = X.keyword_hits(F.coalesce(abstract, F.lit("")), keywords)
    return (
        F.when(cited, 0)
        .when((in_title >= 1) & (in_abstract >= 1), 1)
        .when((in_title >= 1) | (in_abstract >= 2), 2)
        .otherwise(3)
    )


# --- transferability ---------------------------------------------------------------------
def padded(text: Column) -> Column:
    """`` word word `` form for whole-phrase matching."""
    words = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9+-]+", " "))
    return F.concat(F.lit(" "), words, F.lit(" "))


def _names(hay: Column, phrases: list[str]) -> Column:
    hits = F.lit(False)
    for phrase in phrases:
        hits = hits | F.contains(hay, F.lit(f" {phrase} "))
    return hits


DEFAULT_LEXICONS = {
    "institution": V.INSTITUTION_TERMS,
    "artifact": V.ARTIFACT_TERMS,
    "person": V.PERSON_TERMS,
    "variable": [phrase for phrases in V.VARIABLE_LEXICON.values() for phrase in phrases],
    "descriptive": V.DESCRIPTIVE_TERMS,
    "direction": V.DIRECTION_TERMS,
    "specialist": V.SPECIALIST_TERMS,
}


def transferability(
    df: DataFrame, fact: str, boundary: str, source_title: str, lexicons: dict[str, list[str]] | None = None
) -> DataFrame:
    """Add the four check outcomes and both verdicts of a claim.

    ``transferable`` refuses on a failed check or two warnings; ``transferable_v3``
    lets the variable check decide and lists the others as modifiers.
    """
    lex = {**DEFAULT_LEXICONS, **(lexicons or {})}
    claim = F.concat(F.col(fact), F.lit(" "), F.col(boundary))
    context = F.concat(claim, F.lit(" "), F.col(source_title))
    named = df.withColumn("_claim", padded(claim)).withColumn("_context", padded(context))
    c, x = F.col("_claim"), F.col("_context")
    named = (
        named.withColumn("_person", _names(x, lex["person"]))
        .withColumn("_artifact", _names(x, lex["artifact"]))
        .withColumn(
            "subject",
            F.when(~F.col("_person") & ~F.col("_artifact"), "fail")
            .when(_names(x, lex["institution"]), "warn")
            .when(F.col("_artifact"), "pass")
            .otherwise("warn"),
        )
        .withColumn("variable", F.when(_names(c, lex["variable"]), "pass").otherwise("fail"))
        .withColumn(
            "direction",
            F.when(_names(c, lex["descriptive"]), "fail")
            .when(_names(c, lex["direction"]), "pass")
            .otherwise("fail"),
        )
        .withColumn("population", F.when(_names(x, lex["specialist"]), "warn").otherwise("pass"))
    )
    return score_checks(named.drop("_claim", "_context", "_person", "_artifact"))


CHECKS = ["subject", "variable", "direction", "population"]


def score_checks(df: DataFrame) -> DataFrame:
    """Verdict columns from the four outcome columns."""
    outcomes = F.array(*CHECKS)
    failed = F.array_contains(outcomes, "fail")
    warned = F.size(F.filter(outcomes, lambda o: o == "warn"))
    flagged = [F.when(F.col(c) != "pass", F.lit(c)) for c in CHECKS if c != "variable"]
    return (
        df.withColumn("escalated", ~failed & (warned >= 2))
        .withColumn("transferable", ~failed & (warned < 2))
        .withColumn("transferable_v3", F.col("variable") == "pass")
        .withColumn("modifiers", F.array_compact(F.array(*flagged)))
    )


def verdict_drift(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """(item_id, drift): how a stored verdict differs from its replay; equal rows drop out."""
    s = stored.select("item_id", "ruleset", *[F.col(c).alias(f"s_{c}") for c in [*CHECKS, "transferable"]])
    r = recomputed.select("item_id", F.col("ruleset").alias("r_ruleset"), *[F.col(c).alias(f"r_{c}") for c in [*CHECKS, "transferable"]])
    joined = s.join(r, "item_id")
    changed = F.array_compact(
        F.array(*[F.when(~F.col(f"s_{c}").eqNullSafe(F.col(f"r_{c}")), F.concat(F.lit(f"{c}="), F.col(f"r_{c}"))) for c in CHECKS])
    )
    drift = (
        F.when(F.col("ruleset") != F.col("r_ruleset"), "ruleset")
        .when(F.col("s_transferable") != F.col("r_transferable"), "verdict")
        .when(F.size(changed) > 0, F.concat(F.lit("reasoning:"), F.array_join(changed, ",")))
    )
    return joined.withColumn("drift", drift).filter("drift IS NOT NULL").select("item_id", "drift")


def audit_v2(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Audit of verdicts whose variable check came from outside and is kept as stored."""
    cols = ["subject", "direction", "population"]
    r = recomputed.select("item_id", *[F.col(c).alias(f"r_{c}") for c in cols])
    joined = stored.join(r, "item_id")
    lever = F.coalesce(F.length(X.js_trim(F.col("lever"))), F.lit(0)) > 0
    outcomes = F.array(*CHECKS)
    failed = F.array_contains(outcomes, "fail")
    warned = F.size(F.filter(outcomes, lambda o: o == "warn"))
    drift = F.coalesce(
        *[F.when(F.col(c) != F.col(f"r_{c}"), F.concat(F.lit(f"{c} drifted to "), F.col(f"r_{c}"))) for c in cols],
        F.when(~F.col("variable").isin("pass", "fail"), "variable outcome out of range"),
        F.when((F.col("variable") == "pass") & ~lever, "variable passed without a lever"),
        F.when((F.col("variable") == "fail") & lever, "variable failed with a lever"),
        F.when(F.col("transferable") != (~failed & (warned < 2)), "verdict disagrees with checks"),
        F.when(F.col("escalated") != (~failed & (warned >= 2)), "escalation disagrees with checks"),
    )
    return joined.withColumn("drift", drift).filter("drift IS NOT NULL").select("item_id", "drift")
