"""Dates, grades, counters, ids and rounding as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corroborate.functions import text as X
from corroborate.functions import vocabulary as V


def round4(col: Column) -> Column:
    """Half-up rounding to four decimals."""
    return F.floor(col * 10000 + 0.5) / 10000


def round8(col: Column) -> Column:
    return F.floor(col * 100000000 + 0.5) / 100000000


# --- identities ---------------------------------------------------------------
def record_identity(doi: Column, title: Column, year: Column) -> Column:
    """Identity string; null when neither a DOI nor a usable title exists."""
    clean = X.norm_title(title)
    by_title = F.concat(
        F.lit("title-year:"), clean, F.lit(":"), F.coalesce(year.cast("string"), F.lit("undated"))
    )
    return F.coalesce(
        F.concat(F.lit("doi:"), X.norm_doi(doi)), F.when(clean != "", by_title)
    )


def record_id(identity: Column) -> Column:
    return F.concat(F.lit("cr_"), F.substring(F.sha2(identity, 256), 1, 24))


def observation_id(topic: Column, source: Column, locator: Column, observed: Column) -> Column:
    parts = F.concat_ws(
        "\u0000",
        topic,
        F.lower(X.js_trim(source)),
        X.js_trim(locator),
        X.collapse(X.nfkc(observed)),
    )
    return F.concat(F.lit("rr_"), F.substring(F.sha2(parts, 256), 1, 24))


def proposal_id(kind: Column, target: Column, identity: Column) -> Column:
    digest = F.sha2(F.concat_ws("\u0000", kind, target, X.norm_quality(identity)), 256)
    named = F.substring(X.slug(identity), 1, 36)
    return F.concat_ws(
        "-",
        kind,
        X.slug(target),
        F.when(named == "", "item").otherwise(named),
        F.substring(digest, 1, 12),
    )


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


# --- dates --------------------------------------------------------------------
def quarter_key(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string"))


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def seconds(ts: Column) -> Column:
    """Epoch seconds of a timestamp with or without zone (UTC session)."""
    return F.unix_seconds(ts.cast("timestamp"))


def age_hours(ts: Column, now: Column) -> Column:
    return F.floor((seconds(now) - seconds(ts)) / 3600)


def age_days(ts: Column, now: Column) -> Column:
    return F.floor((seconds(now) - seconds(ts)) / 86400)


def price_state(verified_on: Column, now: Column) -> Column:
    elapsed = seconds(now) - seconds(verified_on)
    return (
        F.when(verified_on.isNull(), "unconfigured")
        .when(elapsed > V.PRICE_STALE_DAYS * 86400, "stale")
        .otherwise("current")
    )


# --- grades and statuses --------------------------------------------------------
def grade_rank(grade: Column) -> Column:
    """0 is the strongest grade; null for an unknown one."""
    at = F.array_position(X.literals(V.GRADES), grade)
    return F.when(at > 0, at - 1)


def grade_letter(grade: Column) -> Column:
    return F.substring(grade, 1, 1)


def grade_at_least(grade: Column, cutoff: str) -> Column:
    return grade_rank(grade) <= V.GRADES.index(cutoff)


def weaker_grade(a: Column, b: Column) -> Column:
    return F.when(grade_rank(a) >= grade_rank(b), a).otherwise(b)


def prior_weight(grade: Column) -> Column:
    weights = F.array(*[F.lit(w) for w in V.PRIOR_WEIGHT])
    return F.get(weights, grade_rank(grade).cast("int"))


def status_for(score: Column, green: Column, amber: Column) -> Column:
    return (
        F.when(score.isNull(), "red")
        .when(score >= green, "green")
        .when(score >= amber, "amber")
        .otherwise("red")
    )


def status_rank(status: Column) -> Column:
    return F.when(status == "red", 2).when(status == "amber", 1).otherwise(0)


def status_name(rank: Column) -> Column:
    return F.when(rank == 2, "red").when(rank == 1, "amber").otherwise("green")


# --- counters -------------------------------------------------------------------
def parse_counters(col: Column) -> Column:
    """``k=v k=v`` as an array of (name, value); the last ``=`` splits a pair."""
    pairs = F.filter(F.split(col, r"\s+"), lambda p: p.contains("="))
    return F.transform(
        pairs,
        lambda p: F.struct(
            F.regexp_replace(p, "=[^=]*$", "").alias("name"),
            F.regexp_extract(p, "=([^=]*)$", 1).try_cast("double").alias("value"),
        ),
    )


def known_counters(col: Column, known: list[str]) -> Column:
    """Counters of a known vocabulary with a finite value above zero."""
    return F.filter(
        parse_counters(col),
        lambda c: c["name"].isin(known)
        & c["value"].isNotNull()
        & (c["value"] > 0)
        & ~F.isnan(c["value"])
        & (c["value"] < float("inf")),
    )


def format_counters(counters: Column) -> Column:
    return F.array_join(
        F.transform(
            F.array_sort(counters),
            lambda c: F.concat(c["name"], F.lit("="), c["value"].cast("bigint").cast("string")),
        ),
        " ",
    )


def hex_number(digest: Column, width: int = 15) -> Column:
    """Leading hex digits of a digest as an integer that sums exactly."""
    return F.conv(F.substring(digest, 1, width), 16, 10).cast("decimal(38,0)")
