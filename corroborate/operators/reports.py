"""Aggregated reports and projections for consumers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.functions import text as X
from corroborate.functions import vocabulary as V
from corroborate.functions.scalars import month_key, round8, seconds
from corroborate.operators.phrases import recurring, spelled
from corroborate.operators.skew import latest_per_key, prefix_scan
from corroborate.session import stored


def lifecycle_coverage(topics: DataFrame, parent: str, status: str) -> DataFrame:
    return topics.groupBy(parent, status).agg(F.count(F.lit(1)).alias("topics"))


def monthly_rollup(runs: DataFrame, month: str) -> DataFrame:
    """Runs, calls, seconds, money and tokens of one month per corpus, with a total.

    Money is summed as decimal so the total does not depend on row order.
    """
    chosen = runs.filter(month_key(F.col("run_at")) == month)
    money = F.sum(F.coalesce(F.col("usd"), F.lit(0.0)).cast("decimal(18,8)"))
    return (
        chosen.rollup("corpus")
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"),
            money.cast("double").alias("usd"),
            F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
            F.grouping("corpus").cast("int").alias("is_total"),
        )
        .withColumn("corpus", F.when(F.col("is_total") == 1, "total").otherwise(F.col("corpus")))
        .drop("is_total")
    )


def proposal_counts(proposals: DataFrame) -> DataFrame:
    """Per topic: statuses, decided rows and approval rate; pairs count for both ends.

    ``proposals``: item_id, targets (array), status.
    """
    per_target = proposals.select(F.explode(F.array_distinct("targets")).alias("topic_id"), "status")
    pending = F.col("status").isin("pending", "edited")
    approved, rejected = F.col("status") == "approved", F.col("status") == "rejected"
    counted = per_target.groupBy("topic_id").agg(
        F.count_if(pending).alias("pending"),
        F.count_if(approved).alias("approved"),
        F.count_if(rejected).alias("rejected"),
        F.count_if(F.col("status").startswith("held")).alias("held"),
    )
    decided = F.col("approved") + F.col("rejected")
    rate = F.floor(F.col("approved") / decided * 1000 + 0.5) / 1000
    return counted.withColumn("decided", decided).withColumn("approval_rate", F.when(decided > 0, rate))


def proposal_matrix(proposals: DataFrame, statuses: list[str]) -> DataFrame:
    """type x status counts per topic."""
    return proposals.groupBy("topic_id", "type").pivot("status", statuses).agg(F.count(F.lit(1))).na.fill(0)


def population_report(shelf: DataFrame, records: DataFrame, observations: DataFrame, proposals: DataFrame, dossiers: DataFrame) -> DataFrame:
    """Corpus, observations, proposals and dossier completeness per topic of a shelf."""
    corpus = records.groupBy("topic_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.coalesce(F.length(X.js_trim(F.col("abstract"))), F.lit(0)) > 0).alias("with_abstract"),
    )
    observed = observations.groupBy("topic_id").agg(F.count(F.lit(1)).alias("observations"))
    proposed = proposals.groupBy("topic_id").agg(F.count(F.lit(1)).alias("proposals"))
    out = shelf.select("topic_id")
    for part in (corpus, observed, proposed, dossiers.select("topic_id", "dossier_fields")):
        out = out.join(part, "topic_id", "left")
    return out.na.fill(0, ["records", "with_abstract", "observations", "proposals", "dossier_fields"])


def source_mode_counts(sources: DataFrame) -> DataFrame:
    """Total and done sources per connection mode; done is null where it has no meaning."""
    counted = sources.groupBy("mode").agg(F.count(F.lit(1)).alias("total"), F.count_if("connected").alias("_done"))
    return counted.withColumn(
        "done", F.when(~F.col("mode").isin("manual", "deferred"), F.col("_done"))
    ).drop("_done")


def source_health(sources: DataFrame, heartbeats: DataFrame, now: Column) -> DataFrame:
    """Newest heartbeat per source; stale or missing is unknown, other modes have none."""
    newest = latest_per_key(heartbeats, ["source_id"], ["checked_at"]).select(
        "source_id", "checked_at", F.col("status").alias("beat")
    )
    age = F.floor((seconds(now) - seconds(F.col("checked_at"))) / 3600)
    status = (
        F.when(F.col("mode") == "internal", "n_a")
        .when(F.col("mode") != "api", "none")
        .when(F.col("beat").isNull() | (age >= V.HEARTBEAT_STALE_HOURS), "unknown")
        .otherwise(F.col("beat"))
    )
    shown = F.when(F.col("mode") == "api", age)
    return sources.join(newest, "source_id", "left").select("source_id", status.alias("health"), shown.alias("age_hours"))


def context_weights(preconditions: DataFrame) -> DataFrame:
    """Members of each condition in first-seen order, and of its silencing negation.

    ``preconditions``: pack, topic_id, predicate, seq. Long form: one row per member.
    """
    cleaned = preconditions.withColumn("context", X.strip_predicate(F.col("predicate")))
    members = cleaned.groupBy("pack", "context", "topic_id").agg(F.min("seq").alias("seq"))
    both = F.array(
        F.struct(F.col("context"), F.lit("strong").alias("effect")),
        F.struct(F.concat(F.lit("not ("), "context", F.lit(")")).alias("context"), F.lit("inactive").alias("effect")),
    )
    return members.select("pack", "topic_id", "seq", F.inline(both))


def hard_boundaries(rules: DataFrame) -> DataFrame:
    """First text per rule id of a pack, as a status fact. ``rules``: pack, rule_id, rule, seq."""
    keyed = rules.withColumn("boundary", F.replace(F.col("rule_id"), F.lit("_"), F.lit("-")))
    first = keyed.groupBy("pack", "boundary").agg(F.min_by("rule", "seq").alias("rule"))
    return first.select("pack", "boundary", X.boundary_reason(F.col("rule")).alias("reason"))


def measured_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.select("pack", "metric").distinct()


def segment_provenance(segments: DataFrame) -> DataFrame:
    """Active segments by provenance next to the overall active and retired counts."""
    totals = segments.agg(
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "retired").alias("retired"),
    ).withColumn("_one", F.lit(1))
    by = segments.filter("status = 'active'").groupBy("provenance").agg(F.count(F.lit(1)).alias("segments"))
    return by.withColumn("_one", F.lit(1)).join(totals, "_one").drop("_one")


def queue_counts(queues: dict[str, DataFrame], proposals: DataFrame, runs: DataFrame) -> DataFrame:
    """Sizes of the queues, actionable and held proposals, resumable runs."""
    parts = [q.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("queue"), "n") for name, q in queues.items()]
    parts += [
        proposals.agg(F.count_if(F.col("status").isin(V.ACTIONABLE_STATUSES)).alias("n")).select(F.lit("actionable").alias("queue"), "n"),
        proposals.agg(F.count_if(F.col("status").startswith("held")).alias("n")).select(F.lit("held").alias("queue"), "n"),
        runs.agg(F.count_if("resumable").alias("n")).select(F.lit("resumable").alias("queue"), "n"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def top_per_category(records: DataFrame, k: int) -> DataFrame:
    """The k most cited records of every category; ranking prunes before the shuffle."""
    tagged = records.select("record_id", "title", "year", "citations", F.explode("categories").alias("category"))
    order = Window.partitionBy("category").orderBy(
        F.desc(F.coalesce("citations", F.lit(-1))), F.desc(F.coalesce("year", F.lit(0))), F.asc("record_id")
    )
    return tagged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def latest_runs(runs: DataFrame, n: int) -> DataFrame:
    return runs.orderBy(F.desc("run_at"), F.asc("run_id")).limit(n)


def retain_last(runs: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return runs.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n).drop("_rn")


def corpus_order(records: DataFrame, cap: int) -> DataFrame:
    """Pinned first, then most cited, cut at the storage cap."""
    pinned = F.when(F.col("source_api") == "pinned", 1).otherwise(0)
    return records.orderBy(pinned.desc(), F.desc(F.coalesce("citations", F.lit(-1))), F.asc("record_id")).limit(cap)


def seeded_sample(df: DataFrame, groups: list[str], row_id: str, n: int, seed: int) -> DataFrame:
    """The same n rows per group for the same seed, from a hash order."""
    order = Window.partitionBy(*groups).orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(row_id)), 256), row_id)
    return df.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n).drop("_rn")


def strided_sample(df: DataFrame, row_id: str, count: int) -> DataFrame:
    """``count`` evenly spaced rows in id order; numbering is distributed."""
    numbered = prefix_scan(df.withColumn("_all", F.lit(1)), ["_all"], [F.asc(row_id)], position="rn")
    total = df.agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(1))
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / count))
    return (
        numbered.join(F.broadcast(total), "_all")  # one row
        .filter(((F.col("rn") - 1) % stride == 0) & (F.floor((F.col("rn") - 1) / stride) < count))
        .drop("_all", "rn", "n")
    )


def cells_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cells whose status differs between two snapshots; new and gone cells included."""
    b = before.select("pack", "segment", F.col("status").alias("status_before"))
    a = after.select("pack", "segment", F.col("status").alias("status_after"))
    return b.join(a, ["pack", "segment"], "full_outer").filter(
        ~F.col("status_before").eqNullSafe(F.col("status_after"))
    )


def maturation_entry(before: DataFrame, after: DataFrame, spend_before: float, spend_after: Column, queues: DataFrame) -> DataFrame:
    """One log row: flips to and from green, changed cells, spend since, queue actions."""
    changed = cells_changed(before, after).agg(
        F.count(F.lit(1)).alias("cells_changed"),
        F.count_if(F.coalesce(F.col("status_after") == "green", F.lit(False))).alias("turned_green"),
        F.count_if(F.coalesce(F.col("status_before") == "green", F.lit(False))).alias("left_green"),
    ).withColumn("_one", F.lit(1))
    actions = queues.agg(
        F.count_if(F.col("action") == "run").alias("dispatched"),
        F.count_if(F.col("action") == "defer").alias("deferred"),
        spend_after.alias("_spend"),
    ).withColumn("_one", F.lit(1))
    return changed.join(actions, "_one").select(
        "cells_changed",
        "turned_green",
        "left_green",
        "dispatched",
        "deferred",
        F.greatest(F.lit(0.0), round8(F.col("_spend") - spend_before)).alias("spend_delta"),
    )


def file_checklist(counts: DataFrame) -> DataFrame:
    """covered, missing or unclassified per file and category. ``counts``: path and one
    column per category; all null = never classified."""
    known = F.coalesce(*[F.col(c) for c in V.CATEGORIES]).isNotNull()
    states = [
        F.struct(
            F.lit(c).alias("category"),
            F.when(~known, "unclassified").when(F.coalesce(F.col(c), F.lit(0)) > 0, "covered").otherwise("missing").alias("state"),
        )
        for c in V.CATEGORIES
    ]
    return counts.select("path", F.inline(F.array(*states)))


def uncovered_phrases(texts: DataFrame, known: DataFrame, size: int, min_topics: int) -> DataFrame:
    """Word n-grams recurring in several topics that the known vocabulary lacks.

    ``texts``: topic_id, text; ``known``: text. A first pass counts the topics of hashes
    only, packed; most n-grams stand in too few topics and go no further. A second
    pass spells out those whose hash may have survived and counts them as they are, so two
    n-grams with one hash cost a row and change nothing. A null topic counts as one.
    """
    # Three scans need the normalised texts, which cost more than all else.
    texts = stored(texts.select("topic_id", X.norm_quality(F.col("text")).alias("text")), "texts")
    wanted = recurring(texts, size, min_topics)
    per_topic = spelled(texts, size, wanted).groupBy("phrase", "topic_id").agg(F.count(F.lit(1)).alias("n"))
    counted = per_topic.groupBy("phrase").agg(F.count(F.lit(1)).alias("topics"), F.sum("n").alias("occurrences"))
    found = counted.filter(F.col("topics") >= min_topics)
    old = known.select(F.lit("").alias("topic_id"), X.norm_quality(F.col("text")).alias("text"))
    return found.join(spelled(old, size, wanted).select("phrase").distinct(), "phrase", "left_anti")


def collated_positions(df: DataFrame, keys: list[str], column: str, tie: str, collation: str = "UNICODE") -> DataFrame:
    """Add ``position``: the place of each row in its key's order by the rules of a collation.

    Upper and lower case, accents and signs sort as in a dictionary, not by code point. Rows
    that the collation calls equal follow ``tie``; nulls come last.
    """
    order = [F.collate(F.col(column), collation).asc_nulls_last(), F.col(tie).asc_nulls_last()]
    return prefix_scan(df, keys, order, position="position")


DESIGN_RANK = {
    "meta_analysis": 5, "rct": 4, "quasi_experiment": 3, "observational": 2, "narrative_review": 1, "theoretical": 0,
}


def computed_grade(citations: DataFrame) -> DataFrame:
    """Grade band per item from independent DOIs, designs, agreement and replication.

    ``citations``: item_id, doi, study_design, direction, replication. A single
    record stays below the A band whatever its design.
    """
    rank = F.lit(None).cast("int")
    for name, value in DESIGN_RANK.items():
        rank = F.when(F.col("study_design") == name, value).otherwise(rank)
    folded = citations.groupBy("item_id").agg(
        F.countDistinct("doi").alias("dois"),
        F.max(rank).alias("strongest"),
        (F.countDistinct(F.when(F.col("direction") != "neutral", F.col("direction"))) <= 1).alias("consistent"),
        F.bool_or("replication").alias("replicated"),
    )
    several = (F.col("dois") >= 3) & F.col("consistent") & F.col("replicated")
    top = (F.col("dois") >= 2) & ((F.col("strongest") == DESIGN_RANK["meta_analysis"]) | several)
    middle = (F.col("dois") >= 2) & F.col("consistent") & (F.col("strongest") >= DESIGN_RANK["quasi_experiment"])
    return folded.select(
        "item_id", "dois", F.when(top, "A").when(middle, "B").otherwise("C").alias("band")
    )


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.when(F.sum(weight) > 0, F.sum(weight * value) / F.sum(weight)).otherwise(F.lit(0.0))


def registry_tree(topics: DataFrame) -> DataFrame:
    """Children per parent with kind, validity and status counts."""
    return topics.groupBy("parent").agg(
        F.count_if(F.col("kind") == "full").alias("full_records"),
        F.count_if(F.col("kind") == "stub").alias("stubs"),
        F.count_if((F.col("kind") == "full") & F.col("valid")).alias("valid_records"),
    )


def voice_violations(document: Column) -> Column:
    """Trimmed lines with instruction voice outside the implementation block.

    Comment lines may speak; the block opens and closes on its marker lines, so
    the lines of one document are folded in order inside the row.
    """
    start = F.struct(F.lit(False).alias("inside"), F.expr("CAST(array() AS array<string>)").alias("found"))

    def read(acc: Column, line: Column) -> Column:
        inside = (
            F.when(line == "implementations:", True).when(line == "interactions:", False).otherwise(acc["inside"])
        )
        speaks = X.matches(line, X.VOICE) & ~F.ltrim(line).startswith("#") & ~inside
        return F.struct(
            inside.alias("inside"),
            F.when(speaks, F.array_append(acc["found"], X.js_trim(line))).otherwise(acc["found"]).alias("found"),
        )

    return F.aggregate(F.split(document, "\n"), start, read)["found"]
