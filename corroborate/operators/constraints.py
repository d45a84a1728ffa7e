"""Data-quality constraints. Each returns a violations DataFrame; empty means clean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions import text as X
from corroborate.functions import vocabulary as V
from corroborate.functions.scalars import record_id, record_identity
from corroborate.operators.skew import skew_join


def rule_violations(df: DataFrame, row_id: str, rules: dict[str, Column]) -> DataFrame:
    """Rows failing named rules; a rule that is null does not fail."""
    failed = [F.when(~rule, F.lit(name)) for name, rule in rules.items()]
    return df.select(row_id, F.explode(F.array_compact(F.array(*failed))).alias("violation"))


def domain(col: Column, values: list[str]) -> Column:
    return F.coalesce(col.isin(values), F.lit(False))


def between(col: Column, low, high) -> Column:
    return F.coalesce((col >= low) & (col <= high), F.lit(False))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def unknown_references(df: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows whose non-null key is not in ``known``."""
    ids = known.select(F.col(known_key).alias(key)).distinct()
    return df.filter(F.col(key).isNotNull()).join(ids, key, "left_anti")


def set_difference(declared: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Ids on one side only: declared but absent, or present but undeclared."""
    d, p = declared.select(key).distinct(), present.select(key).distinct()
    return d.join(p, key, "left_anti").withColumn("violation", F.lit("declared_absent")).unionByName(
        p.join(d, key, "left_anti").withColumn("violation", F.lit("present_undeclared"))
    )


def record_ids(df: DataFrame) -> DataFrame:
    """Pattern, recomputed value and uniqueness of stored record ids (col ``stored_id``)."""
    wanted = record_id(record_identity(F.col("doi"), F.col("title"), F.col("year")))
    rules = {
        "pattern": F.coalesce(F.col("stored_id").rlike("^cr_[a-f0-9]{24}$"), F.lit(False)),
        "recomputed": F.col("stored_id").eqNullSafe(wanted),
    }
    named = rule_violations(df, "stored_id", rules).groupBy("stored_id", "violation").agg(F.count(F.lit(1)).alias("rows"))
    twice = duplicate_keys(df, ["stored_id"]).select("stored_id", F.lit("duplicate").alias("violation"), "rows")
    return named.unionByName(twice)


def saturation_identities(reports: DataFrame, curve: DataFrame) -> DataFrame:
    """Saturation reports whose own numbers disagree."""
    length = curve.groupBy("topic_id").agg(F.count(F.lit(1)).alias("curve_rows"))
    joined = reports.join(length, "topic_id", "left")
    return rule_violations(
        joined,
        "topic_id",
        {
            "issued": F.col("queries_issued") == F.coalesce("curve_rows", F.lit(0)),
            "candidates": F.col("topical_confirmed") + F.col("topical_rejected") == F.col("topical_candidates"),
            "reached": F.col("saturation_reached") == (F.col("stop_reason") == "saturation"),
        },
    )


def full_record_rules(topics: DataFrame) -> DataFrame:
    """Implementations with metrics, at least one hard rule, terms where a dossier exists."""
    impls = F.col("implementations")
    return rule_violations(
        topics,
        "topic_id",
        {
            "implementation": F.coalesce(F.size(impls) > 0, F.lit(False)),
            "metrics": F.coalesce(F.forall(impls, lambda i: F.coalesce(F.size(i["metrics"]) > 0, F.lit(False))), F.lit(False)),
            "hard_rule": F.coalesce(F.size("hard_rules") > 0, F.lit(False)),
            "terms": ~F.col("has_dossier") | F.coalesce(F.size("evidence_terms") > 0, F.lit(False)),
        },
    )


def dossier_rules(dossiers: DataFrame, topics: DataFrame, corpus_counts: DataFrame, axes: list[str]) -> DataFrame:
    """Axis sum, roster membership, corpus existence and its dissent category."""
    total = sum((F.col(a) for a in axes[1:]), F.col(axes[0]))
    roster = topics.select("topic_id", F.lit(True).alias("_known")).distinct()
    joined = dossiers.join(roster, "topic_id", "left").join(corpus_counts, "topic_id", "left")
    return rule_violations(
        joined,
        "topic_id",
        {
            "axis_sum": F.col("total") == total,
            "roster": F.coalesce(F.col("_known"), F.lit(False)),
            "corpus": F.coalesce(F.col("records") > 0, F.lit(False)),
            "dissent": F.coalesce(F.col("dissent_records") > 0, F.lit(False)),
        },
    )


def coverage_ledger(coverage: DataFrame, records: DataFrame) -> DataFrame:
    """Reader coverage: known ids, disjoint states, mode within topic, effect within mode.

    ``coverage``: topic_id, kind, mode, effect_id (null = mode level, mode null =
    topic level), record_id, state.
    """
    entry = ["topic_id", "kind", "record_id"]
    unknown = coverage.join(records.select("topic_id", "record_id").distinct(), ["topic_id", "record_id"], "left_anti")
    both = (
        coverage.groupBy(*entry, F.coalesce("mode", F.lit("")).alias("mode"), F.coalesce("effect_id", F.lit("")).alias("effect_id"))
        .agg(F.countDistinct("state").alias("n"))
        .filter("n > 1")
    )
    top = coverage.filter("mode IS NULL").select(*entry, "state").distinct()
    per_mode = coverage.filter("mode IS NOT NULL AND effect_id IS NULL")
    per_effect = coverage.filter("effect_id IS NOT NULL")
    loose_mode = per_mode.join(top, [*entry, "state"], "left_anti")
    loose_effect = per_effect.join(per_mode.select(*entry, "mode", "state").distinct(), [*entry, "mode", "state"], "left_anti")
    named = [("unknown_record", unknown), ("two_states", both), ("mode_outside_topic", loose_mode), ("effect_outside_mode", loose_effect)]
    parts = [df.select("topic_id", "record_id", F.lit(name).alias("violation")) for name, df in named]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def rejection_log(log: DataFrame) -> DataFrame:
    """Logged refusals whose stored comparison text is not what the rules give today."""
    return rule_violations(
        log,
        "log_id",
        {
            "quote_normalized": X.norm_quality(F.col("quote_raw")) == F.col("quote_normalized"),
            "source_normalized": X.norm_quality(F.col("source_raw")) == F.col("source_normalized"),
        },
    )


def run_ledger_links(runs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Runs without a ledger entry, entries without a run, unbalanced and probe runs."""
    real = runs.filter("NOT probe")
    no_entry = real.join(ledger.select("run_id"), "run_id", "left_anti").select("run_id", F.lit("no_ledger").alias("violation"))
    no_run = ledger.join(runs.select("run_id"), "run_id", "left_anti").select("run_id", F.lit("no_run").alias("violation"))
    unbalanced = ledger.filter("NOT balanced").select("run_id", F.lit("unbalanced").alias("violation"))
    probes = runs.filter("probe")
    probe_entry = probes.join(ledger.select("run_id"), "run_id", "left_semi").select("run_id", F.lit("probe_has_ledger").alias("violation"))
    probe_fetch = probes.filter("records_fetched > 0").select("run_id", F.lit("probe_fetched").alias("violation"))
    return no_entry.unionByName(no_run).unionByName(unbalanced).unionByName(probe_entry).unionByName(probe_fetch)


def source_modes(entries: DataFrame, sources: DataFrame, allowed: list[str]) -> DataFrame:
    """Entries of unknown sources or of sources with another connection mode."""
    joined = entries.join(sources.select("source_id", "mode"), "source_id", "left")
    kind = F.when(F.col("mode").isNull(), "unknown_source").when(~F.col("mode").isin(allowed), "wrong_mode")
    return joined.select("source_id", kind.alias("violation")).filter("violation IS NOT NULL").distinct()


def segment_rules(segments: DataFrame, candidates: DataFrame) -> DataFrame:
    twice = duplicate_keys(segments, ["segment"]).select("segment", F.lit("duplicate_segment").alias("violation"))
    again = duplicate_keys(candidates, ["segment"]).select("segment", F.lit("duplicate_candidate").alias("violation"))
    known = candidates.select("segment").join(segments.select("segment"), "segment", "left_semi").distinct()
    return twice.unionByName(again).unionByName(known.withColumn("violation", F.lit("already_segment")))


def pack_rules(packs: DataFrame, roster: DataFrame, cross_cutting: DataFrame, reserved: str) -> DataFrame:
    """Pack map: unique members, known members, no cross-cutting member, reserved id free."""
    twice = duplicate_keys(packs, ["pack", "topic_id"]).select("pack", "topic_id", F.lit("duplicate_member").alias("violation"))
    unknown = packs.join(roster.select("topic_id"), "topic_id", "left_anti").select("pack", "topic_id", F.lit("unknown_member").alias("violation"))
    crossing = packs.join(cross_cutting.select("topic_id"), "topic_id", "left_semi").select("pack", "topic_id", F.lit("cross_cutting_member").alias("violation"))
    taken = packs.filter(F.col("pack") == reserved).select("pack", "topic_id", F.lit("reserved_id").alias("violation"))
    return twice.unionByName(unknown).unionByName(crossing).unionByName(taken)


def interaction_rules(pairs: DataFrame, roster: DataFrame) -> DataFrame:
    """Authored pairs: distinct ends, sorted, known, unique, file named after the pair."""
    ends = roster.select("topic_id").distinct()
    local = rule_violations(
        pairs.withColumn("pair", F.concat_ws("__", "a", "b")),
        "pair",
        {
            "same_ends": F.col("a") != F.col("b"),
            "unsorted": F.col("a") <= F.col("b"),
            "name": F.col("name") == F.concat_ws("__", "a", "b"),
        },
    )
    twice = duplicate_keys(
        pairs.select(F.concat_ws("__", F.least("a", "b"), F.greatest("a", "b")).alias("pair")), ["pair"]
    ).select("pair", F.lit("duplicate_pair").alias("violation"))
    sides = pairs.select(F.concat_ws("__", "a", "b").alias("pair"), F.explode(F.array("a", "b")).alias("topic_id"))
    unknown = sides.join(ends, "topic_id", "left_anti").select("pair", F.lit("unknown_member").alias("violation"))
    return local.unionByName(twice).unionByName(unknown)


def artifact_links(effects: DataFrame, realizations: DataFrame) -> DataFrame:
    """Effect sources among their citations; effect and realization refer to each other.

    ``effects``: effect_id, sources, cited_dois, realization_ids; ``realizations``:
    realization_id, effect_refs, derivation, has_inference.
    """
    uncited = effects.select("effect_id", F.explode(F.array_except("sources", "cited_dois")).alias("what")).select(
        F.col("effect_id").alias("id"), F.lit("source_not_cited").alias("violation")
    )
    down = effects.select("effect_id", F.explode("realization_ids").alias("realization_id"))
    up = realizations.select("realization_id", F.explode("effect_refs").alias("effect_id"))
    one_way = down.join(up, ["effect_id", "realization_id"], "left_anti").select(
        F.col("effect_id").alias("id"), F.lit("not_referenced_back").alias("violation")
    )
    other_way = up.join(down, ["effect_id", "realization_id"], "left_anti").select(
        F.col("realization_id").alias("id"), F.lit("not_listed_by_effect").alias("violation")
    )
    bare = realizations.filter("derivation = 'inferred' AND NOT has_inference").select(
        F.col("realization_id").alias("id"), F.lit("inference_missing").alias("violation")
    )
    return uncited.unionByName(one_way).unionByName(other_way).unionByName(bare)


def is_pipeline_authored(proposed_by: Column) -> Column:
    return F.coalesce(proposed_by.startswith(V.PIPELINE_PREFIX), F.lit(False))


def requires_role(proposed_by: Column, proposed_at: Column) -> Column:
    cutoff = F.to_timestamp(F.lit(V.SPAN_ROLE_REQUIRED_FROM))
    return is_pipeline_authored(proposed_by) & F.coalesce(proposed_at >= cutoff, F.lit(False))


def proposal_rules(proposals: DataFrame, citations: DataFrame, legacy: DataFrame) -> DataFrame:
    """Payload and envelope agree; pipeline rows carry spans and, after the cut-off, roles.

    ``proposals``: item_id, payload_json, envelope_json, proposed_by, proposed_at,
    signature; ``legacy``: signatures exempt from the span rule.
    """
    exempt = legacy.select("signature", F.lit(True).alias("_legacy")).distinct()
    p = skew_join(proposals, exempt, "signature", how="left")
    differs = rule_violations(p, "item_id", {"payload_differs": F.sha2("payload_json", 256) == F.sha2("envelope_json", 256)})
    joined = skew_join(citations, p.select("item_id", "proposed_by", "proposed_at", "_legacy"), "item_id")
    pipeline = is_pipeline_authored(F.col("proposed_by")) & F.col("_legacy").isNull()
    spans = rule_violations(
        joined,
        "item_id",
        {
            "span_missing": ~pipeline | F.col("start").isNotNull(),
            "role_missing": ~(requires_role(F.col("proposed_by"), F.col("proposed_at")) & F.col("_legacy").isNull())
            | F.col("span_role").isNotNull(),
        },
    )
    return differs.unionByName(spans).distinct()


def transition_rules(decisions: DataFrame, proposals: DataFrame) -> DataFrame:
    """Only open proposals may be decided, and a rejection needs a reason."""
    joined = decisions.join(proposals.select("item_id", "status"), "item_id", "left")
    return rule_violations(
        joined,
        "item_id",
        {
            "unknown_proposal": F.col("status").isNotNull(),
            "not_open": F.col("status").isNull() | F.col("status").isin(V.ACTIONABLE_STATUSES),
            "reason_missing": (F.col("decision") != "rejected")
            | (F.coalesce(F.length(X.js_trim(F.col("note"))), F.lit(0)) > 0),
        },
    )


def span_tally(audited: DataFrame) -> DataFrame:
    """Tally of stored spans: with, without, stale and otherwise broken."""
    has = F.col("start").isNotNull()
    return audited.agg(
        F.count_if(has).alias("with_span"),
        F.count_if(~has).alias("without_span"),
        F.count_if(F.array_contains("conditions", "span_stale")).alias("stale"),
        F.count_if(F.array_contains("conditions", "span_out_of_range")).alias("out_of_range"),
        F.count_if(F.array_contains("conditions", "span_does_not_reslice")).alias("does_not_reslice"),
    )
