"""Work queues from gaps, and their admission under budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.functions.scalars import grade_rank, round4, round8, seconds
from corroborate.operators.skew import prefix_scan
from corroborate.session import cut_lineage

STATUS_ORDER = {"red": 0, "amber": 1}
FLAG_BUMP = 100


def gap_size(criterion_score: Column, green: Column) -> Column:
    """Distance to green, at least 0; an unmeasured score counts the whole threshold."""
    return F.sum(F.greatest(F.lit(0.0), green - F.coalesce(criterion_score, F.lit(0.0))))


def cell_importance(judged: DataFrame, weights: DataFrame, fix_types: list[str]) -> DataFrame:
    """Segment weight times the gap size over non-green criteria of the given fixes."""
    open_gaps = judged.filter((F.col("criterion_status") != "green") & F.col("fix_type").isin(fix_types))
    sized = open_gaps.groupBy("pack", "segment").agg(gap_size(F.col("score"), F.col("green")).alias("gap"))
    return sized.join(weights, "segment", "left").select(
        "pack", "segment", round4(F.coalesce("segment_weight", F.lit(1.0)) * F.col("gap")).alias("importance"),
        F.coalesce("segment_weight", F.lit(1.0)).alias("segment_weight"),
    )


def _order(keys: list[str]) -> list[Column]:
    rank = F.when(F.col("status") == "red", 0).otherwise(1)
    return [
        F.desc("importance"), rank.asc(), F.desc("general_only"), F.desc("weakness"), *[F.asc(k) for k in keys],
    ]


def harvest_candidates(cells: DataFrame, members: DataFrame, topics: DataFrame) -> DataFrame:
    """Best cell per (topic, segment) over all packs that ask for its harvest.

    ``cells``: pack, segment, status, importance, segment_weight, general_only;
    ``topics``: topic_id, grade, is_candidate, flagged.
    """
    expanded = cells.join(members, "pack").join(topics, "topic_id")
    weakness = F.when(F.col("is_candidate"), F.lit(2 * FLAG_BUMP)).otherwise(grade_rank(F.col("grade"))) + F.when(
        F.col("flagged"), FLAG_BUMP
    ).otherwise(0)
    scored = expanded.withColumn("weakness", weakness.cast("bigint")).withColumn(
        "importance",
        round4(F.col("importance") + F.when(F.col("is_candidate"), F.col("segment_weight")).otherwise(0.0)),
    )
    best = F.min_by(
        F.struct("pack", "status", "importance", "weakness", "general_only"),
        F.struct(
            (-F.col("importance")).alias("i"),
            F.when(F.col("status") == "red", 0).otherwise(1).alias("s"),
            (~F.col("general_only")).alias("g"),
            (-F.col("weakness")).alias("w"),
            "pack",
        ),
    ).alias("b")
    return scored.groupBy("topic_id", "segment").agg(best).select("topic_id", "segment", "b.*")


def harvest_queue(candidates: DataFrame, repeats: DataFrame, max_tasks: int) -> tuple[DataFrame, DataFrame]:
    """(queue, skipped): the first ``max_tasks`` candidates that are not repeats.

    ``repeats``: (topic_id, segment) whose last harvest used the same terms and
    came back low-novelty. Skips count only before the row that fills the queue.
    """
    marked = candidates.join(
        repeats.select("topic_id", "segment", F.lit(True).alias("repeat")).distinct(), ["topic_id", "segment"], "left"
    ).withColumn("repeat", F.coalesce("repeat", F.lit(False)))
    order = _order(["pack", "topic_id", "segment"])
    queue = marked.filter("NOT repeat").orderBy(*order).limit(max_tasks).drop("repeat")
    ranked = Window.orderBy(*order)
    numbered = queue.withColumn("rank", F.row_number().over(ranked))  # at most max_tasks rows
    last = numbered.filter(F.col("rank") == max_tasks).select(
        F.struct(*_rank_struct()).alias("stop"), F.lit(1).alias("_one")
    )
    before = (
        marked.filter("repeat")
        .withColumn("_one", F.lit(1))
        .join(F.broadcast(last), "_one", "left")  # at most one row
        .filter(F.col("stop").isNull() | (F.struct(*_rank_struct()) < F.col("stop")))
    )
    return numbered, before.agg(F.count(F.lit(1)).alias("low_novelty_skipped"))


def _rank_struct() -> list[Column]:
    return [
        (-F.col("importance")).alias("i"),
        F.when(F.col("status") == "red", 0).otherwise(1).alias("s"),
        (~F.col("general_only")).alias("g"),
        (-F.col("weakness")).alias("w"),
        F.col("pack"),
        F.col("topic_id"),
        F.col("segment"),
    ]


def repeat_harvests(topics: DataFrame, terms: str, last_terms: str, low: str) -> DataFrame:
    same = F.array_sort(F.array_distinct(F.col(terms))) == F.array_sort(F.array_distinct(F.col(last_terms)))
    return topics.filter(same & F.col(low))


def suggested_terms(terms: Column, name: Column, qualifier: Column, limit: int = 3) -> Column:
    base = F.when(F.coalesce(F.size(terms), F.lit(0)) > 0, terms).otherwise(F.array(name))
    return F.transform(F.slice(base, 1, limit), lambda x: F.trim(F.concat_ws(" ", x, qualifier)))


def budget_max_tasks(remaining: Column, share: float, cost_per_task: int, configured: int) -> Column:
    by_budget = F.floor(remaining * share / cost_per_task)
    return F.greatest(F.lit(0), F.least(F.lit(configured), by_budget)).cast("bigint")


MODE_CRITERIA = {
    "effects": ["effect_coverage", "extraction_completeness"],
    "realizations": ["realization_density", "extraction_completeness"],
    "dissent": ["dissent_completeness"],
}


def extraction_queue(judged: DataFrame, members: DataFrame, topics: DataFrame, weights: DataFrame, max_tasks: int) -> DataFrame:
    """Topic x mode tasks that pipeline gaps call for and whose corpus exists.

    ``topics``: topic_id, has_evidence, has_realizations.
    """
    gaps = judged.filter("criterion_status <> 'green' AND fix_type = 'pipeline'")
    modes = [
        F.when(F.col("criterion").isin(criteria), F.lit(mode)) for mode, criteria in MODE_CRITERIA.items()
    ]
    per_mode = gaps.withColumn("mode", F.explode(F.array_compact(F.array(*modes))))
    sized = per_mode.groupBy("pack", "segment", "mode").agg(
        gap_size(F.col("score"), F.col("green")).alias("gap"), F.array_sort(F.collect_set("criterion")).alias("criteria")
    )
    weighted = sized.join(weights, "segment", "left").withColumn(
        "importance", round4(F.coalesce("segment_weight", F.lit(1.0)) * F.col("gap"))
    )
    corpus = F.when(F.col("mode") == "realizations", F.col("has_realizations")).otherwise(F.col("has_evidence"))
    tasks = weighted.join(members, "pack").join(topics, "topic_id").filter(corpus)
    return (
        tasks.groupBy("topic_id", "mode")
        .agg(
            F.max("importance").alias("importance"),
            F.count(F.lit(1)).alias("source_cells"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("criteria")))).alias("criteria"),
        )
        .orderBy(F.desc("importance"), "topic_id", "mode")
        .limit(max_tasks)
    )


def authoring_queue(cells: DataFrame, judged: DataFrame, exhausted: DataFrame, weights: DataFrame) -> DataFrame:
    """Cells only an owner can close: structural gaps, or exhausted harvests."""
    open_gaps = judged.filter("criterion_status <> 'green'")
    structural = open_gaps.filter("fix_type = 'structural'").groupBy("pack", "segment").agg(
        gap_size(F.col("score"), F.col("green")).alias("structural_gap"), F.count(F.lit(1)).alias("structural_gaps")
    )
    harvest = open_gaps.filter("fix_type = 'harvest'").groupBy("pack", "segment").agg(
        gap_size(F.col("score"), F.col("green")).alias("harvest_gap")
    )
    thin = exhausted.select("pack", "segment", F.lit(True).alias("alternative_fill"))
    key = ["pack", "segment"]
    joined = (
        cells.filter("status <> 'green'")
        .join(structural, key, "left")
        .join(harvest, key, "left")
        .join(thin, key, "left")
        .join(weights, "segment", "left")
        .filter("structural_gaps IS NOT NULL OR alternative_fill")
    )
    base = F.coalesce("structural_gap", "harvest_gap", F.lit(0.0))
    return joined.select(
        "pack",
        "segment",
        "status",
        round4(F.coalesce("segment_weight", F.lit(1.0)) * base).alias("importance"),
        F.coalesce("structural_gaps", F.lit(0)).alias("structural_gaps"),
        F.coalesce("alternative_fill", F.lit(False)).alias("alternative_fill"),
    )


# --- budgets -----------------------------------------------------------------------------
def budget_snapshot(usage: DataFrame, usd_cap: float, call_cap: int) -> DataFrame:
    """Caps, use and what is left of the month; never below zero."""
    used = usage.agg(F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd_used"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls_used"))
    return used.select(
        round8(F.col("usd_used")).alias("usd_used"),
        "calls_used",
        F.greatest(F.lit(0.0), round8(usd_cap - F.col("usd_used"))).alias("usd_left"),
        F.greatest(F.lit(0), call_cap - F.col("calls_used")).cast("bigint").alias("calls_left"),
    )


def usage_percent(used: Column, cap: Column) -> Column:
    return F.when(cap <= 0, F.when(used > 0, 100.0).otherwise(0.0)).otherwise(used / cap * 100)


def budget_state(usd_used: Column, usd_cap: Column, tokens_used: Column, token_cap: Column) -> Column:
    spent = (usd_cap <= 0) | (usd_used >= usd_cap) | (token_cap <= 0) | (tokens_used >= token_cap)
    near = (usage_percent(usd_used, usd_cap) >= 80) | (usage_percent(tokens_used, token_cap) >= 80)
    return F.when(spent, "paused").when(near, "warning").otherwise("normal")


def admit(
    calls: Column, records: Column, usd: Column, used_calls: Column, used_usd: Column,
    max_calls: int, max_records: int, call_cap: int, usd_cap: float, raise_cap: bool = False,
) -> Column:
    """Reasons that block a run; empty when it may start."""
    over = (used_calls + calls > call_cap) | (used_usd + usd > usd_cap)
    reasons = [
        F.when(calls > max_calls, "max_calls_per_run"),
        F.when(records > max_records, "max_records_per_run"),
        F.when(F.lit(not raise_cap) & over, "monthly_budget"),
    ]
    return F.array_compact(F.array(*reasons))


MONEY = "decimal(28,9)"
PLACES = 4096  # of a queue that are added up together


def admit_queue(
    queue: DataFrame, key: str, item: str, rank: str, max_calls: int | None = None, max_records: int | None = None
) -> DataFrame:
    """key, item, action, reason: the queue of each key under its budget of calls and of money.

    ``queue`` has calls, records, usd, call_cap, usd_cap, paused and down (a null counts as
    0, as no or, for a cap, as no limit). In order of rank, then item, each task is run if the budget
    that earlier runs left covers its calls and its money; else it is deferred and consumes
    nothing. A task over a limit for one run is skipped, or deferred if it also breaks the
    budget. A paused connector's tasks, then those of a source that is down, are skipped.
    Repeated rows are tasks of their own. Money is counted in decimals of nine places.

    The result is that of one pass in order, found in rounds. Let L be what a key has left and S
    the lesser of L / 2 and its largest open task. Tasks of at most S in both dimensions fit as
    long as S of both is left; so one running sum over them says what is left at every task up
    to the first that takes a dimension below S, or the first larger task that still fits. All up
    to there are decided, and at least one dimension is halved or too small for the task that was
    largest: the rounds are logarithmic in the ratio of the largest task to the least, for
    queues of any length and any mix of keys.
    """
    number = lambda c, zero: F.coalesce(F.col(c).cast(MONEY), F.lit(zero).cast(MONEY)).alias(c)
    unlimited = 10**18
    limits = [("calls", max_calls, "max_calls_per_run"), ("records", max_records, "max_records_per_run")]
    over = [F.when(F.coalesce(F.col(c), F.lit(0)) > limit, reason) for c, limit, reason in limits if limit is not None]
    base = queue.select(
        key, item, F.col(rank).alias("_rank"), F.monotonically_increasing_id().alias("_row"), number("calls", 0), number("usd", 0),
        number("call_cap", unlimited), number("usd_cap", unlimited),
        F.when(F.col("paused"), "paused").when(F.col("down"), "source_down").alias("_blocked"),
        (F.coalesce(*over) if over else F.lit(None).cast("string")).alias("_over"),
    )
    # Places never change: each round adds up inside blocks of places, then over the blocks.
    base = prefix_scan(base, [key], [F.col("_rank"), F.col(item), F.col("_row")], position="_pos")
    base = cut_lineage(base.drop("_rank", "_row").withColumn("_block", F.floor(F.col("_pos") / PLACES)))
    done = base.filter("_blocked IS NOT NULL").select(key, item, F.lit("skip").alias("action"), F.col("_blocked").alias("reason"))
    state = base.filter("_blocked IS NULL").withColumnRenamed("call_cap", "_calls").withColumnRenamed("usd_cap", "_usd").drop("_blocked")
    while True:
        large = (F.col("calls") > F.col("_calls")) | (F.col("usd") > F.col("_usd"))
        done = done.unionByName(state.filter(large).select(key, item, F.lit("defer").alias("action"), F.lit("monthly_budget").alias("reason")))
        decided, state = _admit_half(state.filter(~large), key)
        done = done.unionByName(decided.select(key, item, "action", "reason"))
        state = cut_lineage(state)
        if state.isEmpty():
            return done


def _admit_half(state: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Decided tasks, and the rest with what is left: one dimension at least is below its share S."""
    half = lambda c: 2 * F.col(c) <= F.col(f"_{c}")
    small = F.col("_over").isNull() & half("calls") & half("usd")
    charged = state.withColumn("_small", small)
    charged = charged.withColumns({f"_{c}_small": F.when(F.col("_small"), F.col(c)).otherwise(F.lit(0).cast(MONEY)) for c in ("calls", "usd")})
    inside = Window.partitionBy(key, "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast(MONEY)
    totals = charged.groupBy(key, "_block").agg(
        F.sum("_calls_small").alias("_c"), F.sum("_usd_small").alias("_u"),
        *[F.max(F.when(F.col("_over").isNull(), F.col(c))).alias(f"_top_{c}") for c in ("calls", "usd")],
    )
    whole = Window.partitionBy(key)
    shift = totals.select(
        F.col(key).alias("_k"), F.col("_block").alias("_b"), F.coalesce(F.sum("_c").over(before), none).alias("_c"), F.coalesce(F.sum("_u").over(before), none).alias("_u"),
        *[F.coalesce(F.max(f"_top_{c}").over(whole), none).alias(f"_top_{c}") for c in ("calls", "usd")],
    )
    scanned = charged.withColumns({"_in_c": F.coalesce(F.sum("_calls_small").over(inside), none), "_in_u": F.coalesce(F.sum("_usd_small").over(inside), none)})
    scanned = scanned.join(shift, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b"))).drop("_k", "_b")
    left = {"calls": F.col("_calls") - F.col("_in_c") - F.col("_c"), "usd": F.col("_usd") - F.col("_in_u") - F.col("_u")}
    fits = (F.col("calls") <= left["calls"]) & (F.col("usd") <= left["usd"])
    short = lambda c: ((left[c] - F.col(c)) < F.col(f"_top_{c}")) & (2 * (left[c] - F.col(c)) < F.col(f"_{c}"))
    below = short("calls") | short("usd")
    # A larger task that runs takes its dimension below half, or to it: then nothing else is as large.
    ends = F.col("_over").isNull() & fits & (~F.col("_small") | below)
    now = F.struct("_pos", (left["calls"] - F.col("calls")).cast(MONEY).alias("calls"), (left["usd"] - F.col("usd")).cast(MONEY).alias("usd"))
    scanned = cut_lineage(scanned.withColumns({"_fits": fits, "_ends": ends, "_now": now}).drop("_in_c", "_in_u", "_c", "_u", "_calls_small", "_usd_small", "_top_calls", "_top_usd"))
    first = cut_lineage(scanned.groupBy(key).agg(F.min(F.when(F.col("_ends"), F.col("_now"))).alias("_stop")))
    same = F.col(key).eqNullSafe(F.col("_key"))
    joined = scanned.join(first.withColumnRenamed(key, "_key"), same).drop("_key")
    reached = F.col("_stop").isNull() | (F.col("_pos") <= F.col("_stop._pos"))
    runs = F.col("_small") | (F.col("_over").isNull() & (F.col("_pos") == F.coalesce(F.col("_stop._pos"), F.lit(-1))))
    action = F.when(runs, "run").when(F.col("_over").isNotNull() & F.col("_fits"), "skip").otherwise("defer")
    reason = F.when(action == "skip", F.col("_over")).when(action == "defer", "monthly_budget")
    decided = joined.filter(reached).withColumns({"action": action, "reason": reason})
    rest = joined.filter(~reached).withColumns({"_calls": F.col("_stop.calls"), "_usd": F.col("_stop.usd")})
    return decided, rest.select(*state.columns)


def greedy_admission(queue: DataFrame, key: str, item: str, rank: str, cost: str, cap: str, per_run: int) -> DataFrame:
    """Admit in rank order while the budget of one dimension lasts; see ``admit_queue``.

    Items over ``per_run`` are skipped or, if they also break the cap, deferred.
    """
    columns = [F.col(c) for c in dict.fromkeys((key, item, rank))]
    money = queue.select(*columns, F.lit(0).alias("calls"), F.col(cost).alias("usd"), F.lit(None).cast("int").alias("call_cap"), F.col(cap).alias("usd_cap"), F.col(cost).alias("records"), F.lit(False).alias("paused"), F.lit(False).alias("down"))
    return admit_queue(money, key, item, rank, max_records=per_run).select(key, item, "action")


def due_targets(targets: DataFrame, now: Column, stale_hours: int = 12, fresh_days: int = 7) -> DataFrame:
    """run or skip per target, with the first reason that applies.

    Columns: paused, last_run, every_days, source_status, checked_at, changed_at.
    """
    at = seconds(now)
    since = (at - seconds(F.col("last_run"))) / 86400
    age = (at - seconds(F.col("checked_at"))) / 3600
    changed = (at - seconds(F.col("changed_at"))) / 86400
    reason = (
        F.when(F.col("paused"), "paused")
        .when(since < F.col("every_days"), "not_due")
        .when((F.col("source_status") == "down") & (age < stale_hours), "source_down")
        .when(changed > fresh_days, "unchanged")
    )
    return targets.withColumn("reason", reason).withColumn("action", F.when(reason.isNull(), "run").otherwise("skip"))


# --- reading plans -------------------------------------------------------------------------
def reading_plan(
    eligible: DataFrame, terminal: DataFrame, token_cap: int, batch: int = 25, per_batch: int = 0, per_topic: int = 0,
    anchored: bool = False,
) -> DataFrame:
    """Pending records in reading order with batch numbers, and the prefix that fits.

    A run aimed at one effect (``anchored``) reads by affinity to it, then tier, then id;
    any other run by tier, then citations, then id.

    ``eligible``: topic_id, record_id, tier (null = irrelevant), affinity,
    citations, tokens. Cost of a prefix = its tokens plus ``per_batch`` for every
    started batch plus ``per_topic``; everything after the first overflow of the
    run (topics in id order) is left for a later run.
    """
    pending = eligible.join(terminal, ["topic_id", "record_id"], "left_anti")
    ranked = pending.filter("tier IS NOT NULL").withColumn("citations", F.coalesce("citations", F.lit(-1)))
    by = [F.asc("affinity"), F.asc("tier")] if anchored else [F.asc("tier"), F.desc("citations")]
    order = [*by, F.asc("record_id")]
    numbered = prefix_scan(ranked, ["topic_id"], order, position="rn").withColumn(
        "batch_no", F.floor((F.col("rn") - 1) / batch).cast("bigint")
    )
    opens_batch = F.when((F.col("rn") - 1) % batch == 0, per_batch).otherwise(0)
    opens_topic = F.when(F.col("rn") == 1, per_topic).otherwise(0)
    charged = numbered.withColumn("charge", F.col("tokens") + opens_batch + opens_topic).withColumn("_run", F.lit(1))
    totals = prefix_scan(charged, ["_run"], [F.asc("topic_id"), F.asc("rn")], position="seq", sums={"spent": "charge"})
    return totals.withColumn("selected", F.col("spent") <= token_cap).drop("_run")


def plan_counts(eligible: DataFrame, terminal: DataFrame, plan: DataFrame) -> DataFrame:
    """eligible, done, skipped, selected and remaining records per topic."""
    done = eligible.join(terminal, ["topic_id", "record_id"], "left_semi")
    skipped = eligible.filter("tier IS NULL").join(terminal, ["topic_id", "record_id"], "left_anti")
    parts = (
        eligible.select("topic_id", F.lit("eligible").alias("k"))
        .unionByName(done.select("topic_id", F.lit("done").alias("k")))
        .unionByName(skipped.select("topic_id", F.lit("skipped").alias("k")))
        .unionByName(plan.select("topic_id", F.when(F.col("selected"), "selected").otherwise("remaining").alias("k")))
    )
    names = ["eligible", "done", "skipped", "selected", "remaining"]
    return parts.groupBy("topic_id").agg(*[F.count_if(F.col("k") == n).alias(n) for n in names])


def cost_quote(tokens: Column, calls: Column, in_price: float, out_price: float, out_tokens: int) -> Column:
    return round8(tokens * in_price + calls * out_tokens * out_price)
