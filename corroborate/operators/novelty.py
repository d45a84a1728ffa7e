"""Novelty, saturation, diversity and field size of a collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.functions import vocabulary as V
from corroborate.functions.scalars import hex_number, round4
from corroborate.operators.entity import connected_components, match_any_key
from corroborate.operators.skew import prefix_scan
from corroborate.session import cut_lineage


BLOCK_ROWS = 4096  # of a series that are averaged in one group


def novelty_curve(hits: DataFrame, window: int = 10, queries: DataFrame | None = None, base: DataFrame | None = None) -> DataFrame:
    """Per query: returned, unique, added and cumulative records with rolling rate.

    ``hits``: topic_id, query_index (1, 2, ... per topic), cluster. A cluster
    counts as added by the first query that returned it. ``queries`` (topic_id,
    query_index) names all queries issued, so that one without hits is a step of
    rate 0; ``base`` (topic_id, cluster) names what was known before the first.
    """
    seen = hits.groupBy("topic_id", "query_index", "cluster").agg(F.count(F.lit(1)).alias("n"))
    per_query = seen.groupBy("topic_id", "query_index").agg(
        F.sum("n").alias("returned"), F.count(F.lit(1)).alias("unique_returned")
    )
    if queries is not None:
        issued = queries.select("topic_id", "query_index").distinct()
        counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("returned", "unique_returned")]
        per_query = issued.join(per_query, ["topic_id", "query_index"], "left").select("topic_id", "query_index", *counts)
    first = seen.groupBy("topic_id", "cluster").agg(F.min("query_index").alias("query_index"))
    if base is not None:
        first = first.join(base.select("topic_id", "cluster").distinct(), ["topic_id", "cluster"], "left_anti")
    added = first.groupBy("topic_id", "query_index").agg(F.count(F.lit(1)).alias("records_added"))
    curve = per_query.join(added, ["topic_id", "query_index"], "left").withColumn(
        "records_added", F.coalesce("records_added", F.lit(0))
    )
    return with_rates(curve, window)


def with_rates(curve: DataFrame, window: int) -> DataFrame:
    rated = curve.withColumn(
        "novelty_rate",
        F.when(F.col("unique_returned") > 0, round4(F.col("records_added") / F.col("unique_returned"))).otherwise(F.lit(0.0)),
    )
    scanned = prefix_scan(
        rated, ["topic_id"], [F.col("query_index")], position="step", sums={"cumulative_records": "records_added"}
    )
    return rolling_mean(scanned, ["topic_id"], "step", "novelty_rate", "rolling_rate", window)


def rolling_mean(
    df: DataFrame, keys: list[str], index: str, value: str, out: str, window: int
) -> DataFrame:
    """Mean of the last ``window`` values at a dense integer index, null before that.

    A series is cut into blocks of its index. Each block hands its last ``window`` - 1 rows to
    the next, so no task has to hold a whole series and little more than the rows is moved.
    Values carry four decimals and are summed as integers, which keeps the result independent
    of row order. ``index`` is unique within ``keys``; a null value adds nothing to a mean.
    """
    size = max(BLOCK_ROWS, 8 * window)
    own = F.floor(F.col(index) / size).cast("bigint")
    handed = F.pmod(F.col(index), F.lit(size)) >= size - (window - 1)
    placed = df.withColumn("_block", F.explode(F.when(handed, F.array(own, own + 1)).otherwise(F.array(own))))
    units = F.coalesce(F.floor(F.col(value) * 10000 + 0.5).cast("bigint"), F.lit(0))
    reach = Window.partitionBy(*keys, "_block").orderBy(index).rangeBetween(-(window - 1), 0)
    mean = F.floor(F.sum(units).over(reach) / window + 0.5) / 10000
    rolled = placed.withColumn(out, F.when(F.count(F.lit(1)).over(reach) == window, mean))
    return rolled.filter(F.col("_block") == own).drop("_block")


def saturation_point(curve: DataFrame, minimum_queries: int, threshold: float) -> DataFrame:
    """First step per topic at which the rolling rate says the field is exhausted."""
    reached = (F.col("step") >= minimum_queries) & (F.col("rolling_rate") < threshold)
    return curve.groupBy("topic_id").agg(
        F.min(F.when(reached, F.col("step"))).alias("stop_step"),
        F.max("step").alias("last_step"),
    )


def cut_at_saturation(curve: DataFrame, minimum_queries: int, threshold: float) -> DataFrame:
    stops = saturation_point(curve, minimum_queries, threshold).select("topic_id", "stop_step")
    return (
        curve.join(stops, "topic_id")
        .filter(F.col("stop_step").isNull() | (F.col("step") <= F.col("stop_step")))
        .drop("stop_step")
    )


def stop_reason(curve: DataFrame, minimum_queries: int, threshold: float, record_cap: int) -> DataFrame:
    """saturation, storage cap or call cap per topic."""
    stops = saturation_point(curve, minimum_queries, threshold)
    totals = cut_at_saturation(curve, minimum_queries, threshold).groupBy("topic_id").agg(
        F.max("cumulative_records").alias("records"),
        F.count(F.lit(1)).alias("queries_issued"),
    )
    reason = (
        F.when(F.col("stop_step").isNotNull(), "saturation")
        .when(F.col("records") >= record_cap, "storage_tier_record_cap")
        .otherwise("call_cap")
    )
    return totals.join(stops, "topic_id").select(
        "topic_id", "queries_issued", "records", "stop_step", reason.alias("stop_reason")
    )


def exact_added(
    rows: DataFrame, row_id: str, keys: list[str], step: str, topic: str | None = None, base: DataFrame | None = None
) -> DataFrame:
    """Change in the number of merged records per step, counting later bridges.

    A row that links two earlier clusters lowers the count. Components after step
    t = key values and keyless rows seen by t, less the links of a minimum
    spanning forest (Boruvka rounds over the key graph) made by t.

    With ``topic``, rows meet inside their topic only and one forest serves all topics; a null
    topic is a topic. ``base`` (the columns of ``rows`` but the step) is known before the first step:
    it can be bridged, but adds no step of its own. Every step with rows gives a row, also
    of change 0. Rows without step are left out; repeated rows count once by their keys, keyless
    ones by ``row_id``.
    """
    group = [F.col(topic).alias("topic")] if topic else []
    scope = F.coalesce(F.concat(F.lit("t"), F.col(topic).cast("string")), F.lit("")) if topic else F.lit("")
    tagged = [F.when(F.col(k).isNotNull(), F.concat(scope, F.lit(f"\x01{k}:"), F.col(k))) for k in keys]

    def flatten(df: DataFrame, at: Column) -> DataFrame:
        return df.select(*group, F.col(row_id).alias("row"), at.alias("step"), F.array_compact(F.array(*tagged)).alias("ks"))

    own = ["topic"] if topic else []
    flat = flatten(rows.filter(F.col(step).isNotNull()), F.col(step))
    start = flat.agg(F.min("step")).head()[0] if base is not None else None
    if start is not None:
        flat = flat.unionByName(flatten(base, F.lit(start - 1).cast(flat.schema["step"].dataType)))
    flat = cut_lineage(flat)
    nodes = flat.select(*own, "step", F.explode("ks").alias("node")).groupBy(*own, "node").agg(F.min("step").alias("step"))
    loose = flat.filter(F.size("ks") == 0).groupBy(*own, "row").agg(F.min("step").alias("step"))
    edges = (
        flat.filter(F.size("ks") > 1)
        .select(*own, "step", F.get("ks", F.lit(0)).alias("a"), F.explode("ks").alias("b"))
        .filter("a <> b")
        .groupBy(*own, "a", "b")
        .agg(F.min("step").alias("w"))
    )
    forest = spanning_forest(edges, own)
    changes = (
        nodes.select(*own, "step", F.lit(1).alias("d"))
        .unionByName(loose.select(*own, "step", F.lit(1).alias("d")))
        .unionByName(forest.select(*own, F.col("w").alias("step"), F.lit(-1).alias("d")))
        .unionByName(flat.select(*own, "step", F.lit(0).alias("d")))
    )
    if start is not None:
        changes = changes.filter(F.col("step") >= start)
    added = changes.groupBy(*own, "step").agg(F.sum("d").alias("records_added"))
    return added.withColumnRenamed("topic", topic) if topic else added


def spanning_forest(edges: DataFrame, carried: list[str] = []) -> DataFrame:
    """Minimum spanning forest of (a, b, w) edges; ties broken by the edge ends.

    ``carried`` columns, which depend on the ends, stay with their edges.
    """
    live = cut_lineage(edges.select(*carried, "a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")))
    chosen = live.select(*carried, "a", "b", "w").limit(0)
    while live.limit(1).count():
        rank = F.struct("w", "a", "b", *carried)
        ends = live.select(F.col("ca").alias("c"), rank.alias("e")).unionByName(
            live.select(F.col("cb").alias("c"), rank.alias("e"))
        )
        picked = cut_lineage(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct())
        chosen = chosen.unionByName(picked.select(*carried, "a", "b", "w"))
        links = live.join(picked, ["a", "b", "w"], "left_semi").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        roots = cut_lineage(connected_components(links))
        renamed = (
            live.join(roots.select(F.col("node").alias("ca"), F.col("root").alias("ra")), "ca", "left")
            .join(roots.select(F.col("node").alias("cb"), F.col("root").alias("rb")), "cb", "left")
            .select(*carried, "a", "b", "w", F.coalesce("ra", "ca").alias("ca"), F.coalesce("rb", "cb").alias("cb"))
        )
        live = cut_lineage(renamed.filter("ca <> cb"))
    return chosen


def novelty_report(current: DataFrame, previous: DataFrame | None, row_id: str, keys: list[str]) -> DataFrame:
    """Share of a harvest that was already known; low only above the strict threshold."""
    total = current.agg(F.count(F.lit(1)).alias("unique_records"))
    if previous is None:
        return total.select(
            F.lit(None).cast("bigint").alias("previous_records"),
            "unique_records",
            F.lit(0).cast("bigint").alias("already_known"),
            F.col("unique_records").alias("new_records"),
            F.lit(1.0).alias("novelty_rate"),
            F.lit(False).alias("low_novelty"),
        )
    known = match_any_key(current, previous, row_id, keys).withColumn("_known", F.lit(1))
    marked = current.select(row_id).join(known, row_id, "left")
    counts = marked.agg(
        F.count(F.lit(1)).alias("unique_records"), F.count("_known").alias("already_known")
    ).withColumn("_one", F.lit(1))
    before = previous.agg(F.count(F.lit(1)).alias("previous_records")).withColumn("_one", F.lit(1))
    fresh = F.col("unique_records") - F.col("already_known")
    share = F.col("already_known") / F.col("unique_records")
    some = F.col("unique_records") > 0
    return counts.join(before, "_one").select(
        "previous_records",
        "unique_records",
        "already_known",
        fresh.alias("new_records"),
        F.when(some, round4(fresh / F.col("unique_records"))).otherwise(F.lit(0.0)).alias("novelty_rate"),
        F.when(some, share > V.LOW_NOVELTY_KNOWN_SHARE).otherwise(F.lit(False)).alias("low_novelty"),
    )


def spread_report(queries: DataFrame, hits: DataFrame, dimension: str) -> DataFrame:
    """Queries, returned rows and unique clusters per angle or provider."""
    issued = queries.groupBy(dimension).agg(
        F.count(F.lit(1)).alias("queries"), F.sum("returned").alias("returned")
    )
    unique = hits.groupBy(dimension).agg(F.countDistinct("cluster").alias("unique_records"))
    return issued.join(unique, dimension, "left").withColumn(
        "unique_records", F.coalesce("unique_records", F.lit(0))
    )


def recency(records: DataFrame, now_year: int) -> DataFrame:
    recent = F.count_if(F.col("year") >= now_year - V.RECENT_YEARS)
    return records.agg(
        recent.alias("recent_records"),
        F.when(F.count(F.lit(1)) > 0, round4(recent / F.count(F.lit(1)))).otherwise(F.lit(0.0)).alias("recency_rate"),
    )


def field_estimate(queries: DataFrame, hits: DataFrame, corpus_records: DataFrame) -> DataFrame:
    """Overlap-adjusted size of the field behind the measured search scopes.

    ``queries``: scope, total (null when the provider gave none); ``hits``: scope,
    cluster; ``corpus_records``: one row with ``corpus``.
    """
    measured = queries.filter("total IS NOT NULL").groupBy("scope").agg(F.max("total").alias("total"))
    members = hits.join(measured.select("scope"), "scope", "left_semi").select("scope", "cluster").distinct()
    scopes = measured.agg(F.count(F.lit(1)).alias("measured"), F.sum("total").alias("summed")).withColumn("_one", F.lit(1))
    overlap = members.agg(
        F.count(F.lit(1)).alias("memberships"), F.countDistinct("cluster").alias("observed")
    ).withColumn("_one", F.lit(1))
    size = corpus_records.withColumn("_one", F.lit(1))
    multiplicity = F.when(F.col("observed") > 0, F.col("memberships") / F.col("observed"))
    estimate = F.when(
        (F.col("measured") > 0) & (F.col("multiplicity") > 0),
        F.greatest(F.col("corpus"), F.floor(F.col("summed") / F.col("multiplicity") + 0.5)),
    )
    return (
        scopes.join(overlap, "_one")
        .join(size, "_one")
        .withColumn("multiplicity", multiplicity)
        .select(
            estimate.cast("bigint").alias("estimate"),
            F.col("measured").alias("measured_scopes"),
            F.col("summed").alias("summed_results"),
            round4(F.col("multiplicity")).alias("multiplicity"),
        )
    )


def low_novelty_streak(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Trailing run of low-novelty weeks per target and the week it began.

    Two folds instead of a window: the last novel week, then the weeks after it.
    """
    last = attempts.groupBy(*keys).agg(F.max(F.when(~F.col("low_novelty"), F.col("week"))).alias("_last"))
    joined = attempts.join(last, keys)
    tail = F.col("_last").isNull() | (F.col("week") > F.col("_last"))
    return joined.groupBy(*keys).agg(
        F.count_if(tail).alias("streak"),
        F.min(F.when(tail, F.col("week"))).alias("streak_since"),
        F.count_if(F.col("low_novelty")).alias("low_attempts"),
    )


def run_fingerprint(keys: DataFrame, group: str, order: str, key: str, header: Column) -> DataFrame:
    """Digest of an ordered key list per group plus a header of its settings.

    Every (position, key) pair is hashed on its own and the hashes are summed, so
    the digest depends on the order while no task holds a whole list.
    """
    placed = prefix_scan(keys, [group], [F.col(order)], position="_at")
    hashed = hex_number(F.md5(F.concat_ws(":", F.col("_at").cast("string"), F.col(key))))
    folded = placed.groupBy(group).agg(F.count(F.lit(1)).alias("keys"), F.sum(hashed).alias("_sum"))
    digest = F.sha2(F.concat_ws("|", header, F.col("keys").cast("string"), F.col("_sum").cast("string")), 256)
    return folded.select(group, "keys", digest.alias("fingerprint"))
