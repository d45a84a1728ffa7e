"""Sufficiency matrix: scores of pack x segment cells in long form.

Segments, stages and thresholds are authored configuration and arrive as Python
values; members, topics and measurements are DataFrames. A missing measurement
stays null: it is never read as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions import text as X
from corroborate.functions import vocabulary as V
from corroborate.functions.scalars import (
    grade_at_least,
    round4,
    status_for,
    status_name,
    status_rank,
)

CRITERION_NAMES = [name for name, _, _ in V.CRITERIA]
GROUPS = {name: group for name, group, _ in V.CRITERIA}
FIX_TYPES = {name: fix for name, _, fix in V.CRITERIA}


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """CASE over a small authored mapping."""
    out = F.lit(default)
    for name, value in mapping.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def grid(rows: DataFrame, segments: dict[str, list[str]]) -> DataFrame:
    """Each row once per configured segment, with the stages of that segment."""
    entries = [
        F.struct(F.lit(s).alias("segment"), X.literals(stages).alias("stages"))
        for s, stages in segments.items()
    ]
    return rows.select("*", F.inline(F.array(*entries)))


def member_weights(
    members: DataFrame, topics: DataFrame, segments: dict[str, list[str]], affinity: DataFrame
) -> DataFrame:
    """(pack, segment, topic_id, weight, has_affinity): stage fit times boost, at most 1."""
    placed = grid(members.join(topics, "topic_id"), segments).join(
        affinity.select("segment", "topic_id", "boost"), ["segment", "topic_id"], "left"
    )
    fit = F.when(F.arrays_overlap("funnel_stages", "stages"), 1.0).otherwise(0.5)
    return placed.withColumn(
        "weight", F.least(F.lit(1.0), fit * F.coalesce("boost", F.lit(1.0)))
    ).withColumn("has_affinity", F.col("boost").isNotNull())


def measured_mean(value: str) -> Column:
    """Mean that is null as soon as one member is unmeasured, or none exist."""
    n = F.count(F.lit(1))
    return F.when(F.count(value) == n, round4(F.avg(value)))


def topic_scores(topics: DataFrame, effects_target: int = 2, realizations_target: int = 3, providers: int = 2) -> DataFrame:
    """Per-topic measurements of the criteria that do not depend on the segment.

    Input columns: saturated, records, estimate, estimate_override, contributing,
    recency_rate, effects, realizations, current_records, processed_records,
    has_ledger.
    """
    estimate = F.coalesce("estimate_override", "estimate")
    return topics.select(
        "topic_id",
        F.when(F.col("saturated"), 1.0).when(~F.col("saturated"), 0.0).alias("saturation_reached"),
        F.when(estimate > 0, F.least(F.lit(1.0), F.coalesce("records", F.lit(0)) / estimate)).alias(
            "corpus_size_vs_field_estimate"
        ),
        F.least(F.lit(1.0), F.col("contributing") / providers).alias("source_diversity"),
        F.col("recency_rate").alias("recency_balance"),
        F.least(F.lit(1.0), F.coalesce("effects", F.lit(0)) / effects_target).alias("effect_coverage"),
        F.least(F.lit(1.0), F.coalesce("realizations", F.lit(0)) / realizations_target).alias("realization_density"),
        F.when(
            F.col("has_ledger") & (F.col("current_records") > 0),
            F.col("processed_records") / F.col("current_records"),
        ).alias("extraction_completeness"),
    )


MEAN_CRITERIA = [
    "saturation_reached", "corpus_size_vs_field_estimate", "source_diversity", "recency_balance",
    "effect_coverage", "realization_density", "extraction_completeness",
]


def pack_scores(members: DataFrame, scores: DataFrame) -> DataFrame:
    """Null-poisoned means per pack, long form."""
    joined = members.join(scores, "topic_id", "left")
    wide = joined.groupBy("pack").agg(*[measured_mean(c).alias(c) for c in MEAN_CRITERIA])
    return wide.unpivot("pack", MEAN_CRITERIA, "criterion", "score")


def quality_scores(weights: DataFrame, grade_weights: dict[str, float]) -> DataFrame:
    """dissent (unweighted), grade and freshness (weighted) per cell, long form.

    ``weights`` carries dissent, grade and flagged of each member.
    """
    graded = lookup(grade_weights, F.substring("grade", 1, 1), 0.0)
    flagged = F.when(F.col("flagged"), 1.0).otherwise(0.0)
    total = F.sum("weight")
    present = F.coalesce(F.length(X.js_trim(F.col("dissent"))) > 0, F.lit(False))
    wide = weights.groupBy("pack", "segment").agg(
        round4(F.count_if(present) / F.count(F.lit(1))).alias("dissent_completeness"),
        round4(F.sum(F.col("weight") * graded) / total).alias("grade_sufficiency"),
        round4(1 - F.sum(F.col("weight") * flagged) / total).alias("freshness"),
    )
    return wide.unpivot(
        ["pack", "segment"], ["dissent_completeness", "grade_sufficiency", "freshness"], "criterion", "score"
    )


def uncovered_stages(weights: DataFrame, min_grade: str = "B") -> DataFrame:
    """(pack, segment, stage) no member of sufficient grade covers."""
    wanted = weights.select("pack", "segment", F.explode("stages").alias("stage")).distinct()
    able = weights.filter(grade_at_least(F.col("grade"), min_grade)).select(
        "pack", "segment", F.explode(F.array_except("funnel_stages", "excluded_stages")).alias("stage")
    )
    return wanted.join(able.distinct(), ["pack", "segment", "stage"], "left_anti")


def context_coverage(weights: DataFrame, min_grade: str = "B") -> DataFrame:
    missing = uncovered_stages(weights, min_grade).groupBy("pack", "segment").agg(F.count(F.lit(1)).alias("missing"))
    wanted = weights.groupBy("pack", "segment").agg(F.max(F.size("stages")).alias("wanted"))
    return wanted.join(missing, ["pack", "segment"], "left").select(
        "pack",
        "segment",
        F.lit("context_coverage").alias("criterion"),
        round4(1 - F.coalesce("missing", F.lit(0)) / F.col("wanted")).alias("score"),
    )


def with_thresholds(scores: DataFrame, thresholds: dict[str, tuple[float, float]]) -> DataFrame:
    """Add green, amber, status, fix_type and group to long scores."""
    green, amber = thresholds["default"]
    name = F.col("criterion")
    g = lookup({k: v[0] for k, v in thresholds.items() if k != "default"}, name, green)
    a = lookup({k: v[1] for k, v in thresholds.items() if k != "default"}, name, amber)
    return (
        scores.withColumn("green", g)
        .withColumn("amber", a)
        .withColumn("criterion_status", status_for(F.col("score"), F.col("green"), F.col("amber")))
        .withColumn("fix_type", lookup(FIX_TYPES, name))
        .withColumn("criterion_group", lookup(GROUPS, name))
    )


def cell_status(judged: DataFrame) -> DataFrame:
    """Worst criterion per cell, per group, and the non-green criteria."""
    rank = status_rank(F.col("criterion_status"))
    aggs = [F.max(rank).alias("_worst")]
    for group in ("breadth", "depth", "quality"):
        mine = F.col("criterion_group") == group
        aggs.append(F.max(F.when(mine, rank)).alias(f"_{group}"))
        aggs.append(F.bool_or(mine & F.col("score").isNull()).alias(f"_{group}_null"))
    for name in CRITERION_NAMES:
        open_gap = (F.col("criterion") == name) & (F.col("criterion_status") != "green")
        aggs.append(F.bool_or(open_gap).alias(f"_gap_{name}"))
    folded = judged.groupBy("pack", "segment").agg(*aggs)
    gaps = F.array_compact(F.array(*[F.when(F.col(f"_gap_{n}"), F.lit(n)) for n in CRITERION_NAMES]))
    groups = [
        F.when(F.col(f"_{g}_null"), "unmeasured").otherwise(status_name(F.col(f"_{g}"))).alias(f"{g}_status")
        for g in ("breadth", "depth", "quality")
    ]
    return folded.select("pack", "segment", status_name(F.col("_worst")).alias("status"), gaps.alias("gaps"), *groups)


def typed_gaps(judged: DataFrame, cells: DataFrame) -> DataFrame:
    """Non-green criteria with their fix, plus the evidence pseudo-gap.

    ``cells``: pack, segment, status, segment_evidence.
    """
    scored = judged.filter("criterion_status <> 'green'").select(
        "pack", "segment", "criterion", F.col("score").alias("value"), F.col("green").alias("threshold"), "fix_type"
    )
    pseudo = cells.filter("segment_evidence = 'general_only' AND status <> 'green'").select(
        "pack",
        "segment",
        F.lit("segment_evidence").alias("criterion"),
        F.lit(0.0).alias("value"),
        F.lit(1.0).alias("threshold"),
        F.lit("harvest").alias("fix_type"),
    )
    return scored.unionByName(pseudo)


def segment_evidence(weights: DataFrame) -> DataFrame:
    touched = F.bool_or("has_affinity")
    return weights.groupBy("pack", "segment").agg(
        F.when(touched, "segment_specific").otherwise("general_only").alias("segment_evidence")
    )


def bootstrap_cells(packs: DataFrame, unconfigured: list[str]) -> DataFrame:
    """Cells of a segment without stages: every criterion unmeasured, status red."""
    cells = [F.struct(F.lit(s).alias("segment"), F.lit(c).alias("criterion")) for s in unconfigured for c in CRITERION_NAMES]
    return packs.select("pack", F.inline(F.array(*cells))).withColumn("score", F.lit(None).cast("double"))


def candidate_pendency(cells: DataFrame, candidates: DataFrame) -> DataFrame:
    """Force cells of packs with a candidate member to red and count those members.

    ``candidates``: pack, topic_id of seed members; it stays the trace list.
    """
    waiting = candidates.groupBy("pack").agg(F.countDistinct("topic_id").alias("candidate_members"))
    joined = cells.join(waiting, "pack", "left")
    pending = F.col("candidate_members").isNotNull()
    forced = [
        F.when(pending, "red").otherwise(F.col(c)).alias(c)
        for c in ("status", "breadth_status", "depth_status", "quality_status")
    ]
    keep = [c for c in cells.columns if not c.endswith("status")]
    return joined.select(*keep, *forced, F.coalesce("candidate_members", F.lit(0)).alias("candidate_members"))


def exhaustion(cells: DataFrame, judged: DataFrame, members: DataFrame, streaks: DataFrame, k: int) -> DataFrame:
    """Non-green cells whose every member has come back low-novelty ``k`` weeks running.

    ``streaks``: topic_id, segment, streak, streak_since, low_attempts.
    """
    open_cells = cells.filter("status <> 'green'").select("pack", "segment")
    scored = judged.filter("criterion_status <> 'green' AND fix_type = 'harvest' AND score IS NOT NULL")
    harvestable = open_cells.join(scored.select("pack", "segment").distinct(), ["pack", "segment"], "left_semi")
    tracked = harvestable.join(members.select("pack", "topic_id"), "pack").join(streaks, ["topic_id", "segment"], "left")
    ready = F.coalesce(F.col("streak") >= k, F.lit(False)) & F.col("streak_since").isNotNull()
    return (
        tracked.groupBy("pack", "segment")
        .agg(
            F.bool_and(ready).alias("_all"),
            F.sum("low_attempts").alias("attempts"),
            F.min("streak").alias("weeks"),
            F.max("streak_since").alias("since"),
        )
        .filter("_all")
        .drop("_all")
    )


def cell_route(cells: DataFrame, gaps: DataFrame, exhausted: DataFrame) -> DataFrame:
    """green, exhausted, harvest, pipeline or authoring per cell."""
    kinds = gaps.groupBy("pack", "segment").agg(
        F.bool_or((F.col("fix_type") == "harvest") & (F.col("criterion") != "segment_evidence")).alias("harvestable"),
        F.bool_or(F.col("fix_type") == "pipeline").alias("extractable"),
    )
    thin = exhausted.select("pack", "segment", F.lit(True).alias("thin"))
    route = (
        F.when(F.col("status") == "green", "green")
        .when(F.col("thin"), "exhausted")
        .when(F.col("harvestable"), "harvest")
        .when(F.col("extractable"), "pipeline")
        .otherwise("authoring")
    )
    return (
        cells.join(kinds, ["pack", "segment"], "left")
        .join(thin, ["pack", "segment"], "left")
        .select("pack", "segment", "status", route.alias("route"))
    )


def band(route: Column, status: Column) -> Column:
    return F.when(route == "harvest", status).otherwise(route)


BANDS = ["red", "amber", "green", "authoring", "pipeline", "exhausted"]


def coverage_counts(routed: DataFrame) -> DataFrame:
    """Cells per band overall, per pack and per segment in one grouping-sets pass."""
    banded = routed.withColumn("band", band(F.col("route"), F.col("status")))
    counts = [F.count_if(F.col("band") == b).alias(b) for b in BANDS]
    share = F.floor(100 * F.count_if(F.col("band") == "green") / F.count(F.lit(1)) + 0.5).cast("bigint")
    sets = [[], [F.col("pack")], [F.col("segment")]]
    return (
        banded.groupingSets(sets, F.col("pack"), F.col("segment"))
        .agg(*counts, F.count(F.lit(1)).alias("total"), share.alias("pct_green"))
        .withColumn(
            "scope", F.when(F.col("pack").isNotNull(), "pack").when(F.col("segment").isNotNull(), "segment").otherwise("overall")
        )
        .withColumn("key", F.coalesce("pack", "segment", F.lit("all")))
        .select("scope", "key", *BANDS, "total", "pct_green")
    )


def heatmap(cells: DataFrame, segments: list[str]) -> DataFrame:
    """Status per pack with one column per segment; null where not scored."""
    return cells.groupBy("pack").pivot("segment", segments).agg(F.first("status"))


def cell_novelty(members: DataFrame, streaks: DataFrame) -> DataFrame:
    size = members.groupBy("pack").agg(F.count(F.lit(1)).alias("members"))
    hot = members.join(streaks.filter("streak >= 1"), "topic_id").groupBy("pack", "segment").agg(
        F.count(F.lit(1)).alias("streaking")
    )
    return hot.join(size, "pack")


def dossier_gate(df: DataFrame, axes: list[str]) -> DataFrame:
    """Total of the axis scores and whether the dossier may incubate."""
    scored = F.lit(True)
    for axis in axes:
        scored = scored & F.col(axis).isNotNull()
    total = sum((F.col(a) for a in axes[1:]), F.col(axes[0]))
    verdict = (
        F.when(~scored, "unscored")
        .when((total >= 11) & (F.col("evidence") >= 2) & (F.col("safety") >= 2), "incubating")
        .otherwise("rejected")
    )
    return df.withColumn("total", F.when(scored, total)).withColumn("verdict", verdict)
