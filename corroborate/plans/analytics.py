"""Aggregates, windows, sorts, graph and novelty queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corroborate.functions import scalars as S
from corroborate.functions import text as X
from corroborate.operators import classify as C
from corroborate.operators import graph as K
from corroborate.operators import ledger as O
from corroborate.operators import novelty as L
from corroborate.operators import reports as Q
from corroborate.operators.grounding import first_marker
from corroborate.operators.skew import prefix_scan
from corroborate.plans.entity import CLUSTER_SQL, STATUSES, halves, resolved, status_of, _HALVES, MATCH_SQL
from corroborate.plans.evidence import DATA_MARKERS, classify_sql, fires_sql, _PROBE
from corroborate.plans.registry import Tables, query
from corroborate.plans.views import KEYED_SQL, NOW_YEAR, RECORDS_SQL, keyed_records, records

R4 = "floor(({0}) * 10000 + 0.5) / 10000"


# --- aggregates ---------------------------------------------------------------------------
@query(
    "lifecycle_coverage",
    "SELECT c_mktsegment AS parent, CASE WHEN c_acctbal < 0 THEN 'retired' WHEN c_acctbal < 5000 THEN 'active' ELSE 'seed' END AS status, count(*) AS topics FROM customer GROUP BY 1, 2",
)
def lifecycle_coverage(t: Tables):
    status = F.when(F.col("c_acctbal") < 0, "retired").when(F.col("c_acctbal") < 5000, "active").otherwise("seed")
    topics = t.customer.select(F.col("c_mktsegment").alias("parent"), status.alias("status"))
    return Q.lifecycle_coverage(topics, "parent", "status")


def _runs(t: Tables):
    return t.events.select(
        F.col("event_type").alias("corpus"),
        F.col("ts").alias("run_at"),
        F.col("event_id").alias("run_id"),
        (F.col("user_id") % 20).alias("calls"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("usd"),
        (F.col("event_id") % 1000).alias("tokens"),
    )


@query(
    "monthly_rollup",
    """SELECT coalesce(event_type, 'total') AS corpus, count(*) AS runs, CAST(sum(user_id % 20) AS BIGINT) AS calls,
    CAST(sum(CAST(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END AS DECIMAL(18, 8))) AS DOUBLE) AS usd, CAST(sum(event_id % 1000) AS BIGINT) AS tokens
    FROM events WHERE strftime(ts, '%Y-%m') = '2024-01' GROUP BY ROLLUP (event_type)""",
)
def monthly_rollup(t: Tables):
    return Q.monthly_rollup(_runs(t), "2024-01")


_STATUS_SQL = "CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STATUSES)) + " END"


def _proposals(t: Tables):
    return t.orders.select(
        F.col("o_orderkey").alias("item_id"),
        F.array(F.col("o_custkey") % 50, F.when(F.col("o_orderkey") % 4 == 0, (F.col("o_custkey") + 1) % 50).otherwise(F.col("o_custkey") % 50)).alias("targets"),
        status_of(F.col("o_orderkey")).alias("status"),
        F.substring("o_orderpriority", 1, 1).alias("type"),
        (F.col("o_custkey") % 50).alias("topic_id"),
    )


@query(
    "proposal_counts",
    f"""WITH p AS (SELECT DISTINCT o_orderkey, {_STATUS_SQL} AS status, unnest([o_custkey % 50, CASE WHEN o_orderkey % 4 = 0 THEN (o_custkey + 1) % 50 ELSE o_custkey % 50 END]) AS topic_id FROM orders),
    c AS (SELECT topic_id, count_if(status IN ('pending', 'edited')) AS pending, count_if(status = 'approved') AS approved, count_if(status = 'rejected') AS rejected, count_if(starts_with(status, 'held')) AS held FROM p GROUP BY 1)
    SELECT *, approved + rejected AS decided, CASE WHEN approved + rejected > 0 THEN floor(approved / (approved + rejected) * 1000 + 0.5) / 1000 END AS approval_rate FROM c""",
)
def proposal_counts(t: Tables):
    return Q.proposal_counts(_proposals(t))


@query(
    "proposal_matrix",
    f"""SELECT o_custkey % 50 AS topic_id, substr(o_orderpriority, 1, 1) AS type, {', '.join(f"count_if({_STATUS_SQL} = '{s}') AS {s}" for s in STATUSES)} FROM orders GROUP BY 1, 2""",
)
def proposal_matrix(t: Tables):
    return Q.proposal_matrix(_proposals(t), STATUSES)


@query(
    "population_report",
    f"""WITH {RECORDS_SQL}, r AS (SELECT topic_id, count(*) AS records, count_if(trim(coalesce(abstract, ''), ' ' || chr(10)) <> '') AS with_abstract FROM records GROUP BY 1),
    o AS (SELECT lang AS topic_id, count(*) AS observations FROM conversations JOIN documents ON doc_id = conv_id GROUP BY 1),
    p AS (SELECT lang AS topic_id, count(*) AS proposals FROM labels JOIN documents USING (doc_id) GROUP BY 1),
    d AS (SELECT lang AS topic_id, count(DISTINCT source) AS dossier_fields FROM documents WHERE lang <> 'es' GROUP BY 1)
    SELECT topic_id, records, with_abstract, coalesce(observations, 0) AS observations, coalesce(proposals, 0) AS proposals, coalesce(dossier_fields, 0) AS dossier_fields
    FROM r LEFT JOIN o USING (topic_id) LEFT JOIN p USING (topic_id) LEFT JOIN d USING (topic_id)""",
)
def population_report(t: Tables):
    langs = t.documents.select("doc_id", F.col("lang").alias("topic_id"))
    shelf = langs.select("topic_id").distinct()
    observed = t.conversations.select(F.col("conv_id").alias("doc_id")).join(langs, "doc_id")
    proposed = t.labels.select("doc_id").join(langs, "doc_id")
    dossiers = t.documents.filter("lang <> 'es'").groupBy(F.col("lang").alias("topic_id")).agg(F.countDistinct("source").alias("dossier_fields"))
    return Q.population_report(shelf, records(t), observed, proposed, dossiers)


MODES = ["api", "internal", "report", "manual", "deferred"]
_MODE_SQL = "CASE user_id % 5 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MODES)) + " END"


def _sources(t: Tables):
    mode = F.get(X.literals(MODES), (F.col("user_id") % 5).cast("int"))
    return t.events.groupBy(F.col("user_id").alias("source_id"), mode.alias("mode")).agg(
        F.bool_or(F.col("value") > 90).alias("connected")
    )


@query(
    "source_mode_counts",
    f"""WITH s AS (SELECT user_id, {_MODE_SQL} AS mode, bool_or(value > 90) AS connected FROM events GROUP BY 1, 2)
    SELECT mode, count(*) AS total, CASE WHEN mode NOT IN ('manual', 'deferred') THEN count_if(connected) END AS done FROM s GROUP BY mode""",
)
def source_mode_counts(t: Tables):
    return Q.source_mode_counts(_sources(t))


@query(
    "source_health",
    f"""WITH b AS (SELECT user_id, {_MODE_SQL} AS mode, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS beat FROM events GROUP BY 1, 2),
    a AS (SELECT *, CAST(floor((epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts))) / 3600) AS BIGINT) AS age FROM b)
    SELECT user_id AS source_id, CASE WHEN mode = 'internal' THEN 'n_a' WHEN mode <> 'api' THEN 'none' WHEN age >= 12 THEN 'unknown' ELSE beat END AS health,
    CASE WHEN mode = 'api' THEN age END AS age_hours FROM a""",
)
def source_health(t: Tables):
    beats = t.events.select(F.col("user_id").alias("source_id"), F.col("ts").alias("checked_at"), F.col("event_type").alias("status"))
    return Q.source_health(_sources(t), beats, F.to_timestamp(F.lit("2024-01-31")))


@query(
    "weighted_mean",
    f"SELECT l_returnflag, {R4.format('sum(l_quantity * l_extendedprice) / sum(l_quantity)')} AS mean_price, CASE WHEN count_if(l_discount = 0) = 0 THEN avg(l_discount) END AS measured FROM lineitem GROUP BY 1",
)
def weighted_mean(t: Tables):
    mean = Q.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity"))
    from corroborate.operators.matrix import measured_mean

    rows = t.lineitem.withColumn("known", F.when(F.col("l_discount") != 0, F.col("l_discount")))
    return rows.groupBy("l_returnflag").agg(S.round4(mean).alias("mean_price"), measured_mean("known").alias("measured"))


@query(
    "context_weights",
    """WITH m AS (SELECT p_type AS pack, p_name AS context, p_brand AS topic_id, min(p_partkey) AS seq FROM part GROUP BY 1, 2, 3)
    SELECT pack, context, 'strong' AS effect, topic_id, seq FROM m UNION ALL SELECT pack, 'not (' || context || ')', 'inactive', topic_id, seq FROM m""",
)
def context_weights(t: Tables):
    rows = t.part.select(
        F.col("p_type").alias("pack"),
        F.col("p_brand").alias("topic_id"),
        F.concat("p_name", F.lit(" == true")).alias("predicate"),
        F.col("p_partkey").alias("seq"),
    )
    return Q.context_weights(rows)


@query(
    "hard_boundaries",
    """SELECT p_type AS pack, replace(p_brand, '#', '-') AS boundary, 'forbidden — ' || arg_min(p_name, p_partkey) AS reason FROM part GROUP BY 1, 2""",
)
def hard_boundaries(t: Tables):
    rules = t.part.select(
        F.col("p_type").alias("pack"),
        F.replace("p_brand", F.lit("#"), F.lit("_")).alias("rule_id"),
        F.concat(F.lit("Never "), "p_name").alias("rule"),
        F.col("p_partkey").alias("seq"),
    )
    return Q.hard_boundaries(rules)


@query("measured_metrics", "SELECT DISTINCT p_type AS pack, p_brand AS metric FROM part")
def measured_metrics(t: Tables):
    return Q.measured_metrics(t.part.select(F.col("p_type").alias("pack"), F.col("p_brand").alias("metric")))


REASONS = ["no_citations", "malformed_citation", "unknown_record_id", "quote_not_in_source"]


def _detail(t: Tables):
    """conversation turns as candidate rows: role decides the pass, turn the fate."""
    n = F.col("conv_id") + F.col("turn")
    cheap = F.get(X.literals(["into_synthesis", "dropped_ungrounded", "synthesis_batch_failed"]), (n % 3).cast("int"))
    strong = F.get(
        X.literals(["proposed", "dropped_ungrounded", "merged_into_pending", "held_low_confidence", "proposed_enrich", "failed_validation", "dropped_volume_cap"]),
        (n % 7).cast("int"),
    )
    is_cheap = F.col("role") == "user"
    fate = F.when(is_cheap, cheap).otherwise(strong)
    reason = F.when((fate == "dropped_ungrounded") & (F.col("conv_id") % 5 != 0), F.get(X.literals(REASONS), (F.col("conv_id") % 4).cast("int")))
    return t.conversations.select(
        F.concat(F.lit("run"), F.col("conv_id") % 12).alias("run_id"),
        F.concat_ws(":", "conv_id", "turn").alias("candidate_id"),
        (F.col("conv_id") % 30).alias("topic_id"),
        F.when(is_cheap, "cheap").otherwise("strong").alias("pass"),
        fate.alias("fate"),
        reason.alias("reason"),
        F.when(F.col("turn") % 2 == 1, "recorded").alias("attribution"),
    )


DETAIL_SQL = """detail AS (SELECT 'run' || (conv_id % 12) AS run_id, conv_id || ':' || turn AS candidate_id, conv_id % 30 AS topic_id, conv_id, turn,
  CASE WHEN role = 'user' THEN 'cheap' ELSE 'strong' END AS pass,
  CASE WHEN role = 'user' THEN ['into_synthesis', 'dropped_ungrounded', 'synthesis_batch_failed'][1 + (conv_id + turn) % 3]
    ELSE ['proposed', 'dropped_ungrounded', 'merged_into_pending', 'held_low_confidence', 'proposed_enrich', 'failed_validation', 'dropped_volume_cap'][1 + (conv_id + turn) % 7] END AS fate,
  CASE WHEN conv_id % 5 <> 0 THEN ['no_citations', 'malformed_citation', 'unknown_record_id', 'quote_not_in_source'][1 + conv_id % 4] END AS reason,
  CASE WHEN turn % 2 = 1 THEN 'recorded' END AS attribution FROM conversations)"""


@query(
    "drop_reason_counts",
    f"""WITH {DETAIL_SQL} SELECT run_id, pass, {', '.join(f"count(*) FILTER (WHERE reason = '{r}') AS {r}" for r in REASONS)}, count(*) AS total FROM detail WHERE fate = 'dropped_ungrounded' GROUP BY 1, 2""",
)
def drop_reason_counts(t: Tables):
    return O.drop_reason_counts(_detail(t), REASONS)


@query(
    "segment_provenance",
    """WITH s AS (SELECT p_brand || p_type AS id, min(p_name) AS provenance, max(p_size) > 48 AS retired FROM part GROUP BY 1)
    SELECT provenance, count(*) AS segments, (SELECT count_if(NOT retired) FROM s) AS active, (SELECT count_if(retired) FROM s) AS retired FROM s WHERE NOT retired GROUP BY 1""",
)
def segment_provenance(t: Tables):
    s = t.part.groupBy(F.concat("p_brand", "p_type").alias("segment")).agg(
        F.min("p_name").alias("provenance"), F.when(F.max("p_size") > 48, "retired").otherwise("active").alias("status")
    )
    return Q.segment_provenance(s)


@query(
    "triage_summary",
    """WITH f AS (SELECT l_orderkey AS item_id, CASE WHEN l_quantity > 45 THEN 'overreach' WHEN l_discount > 0.09 THEN 'duplicate' WHEN l_tax > 0.075 THEN 'weak_anchor' END AS kind FROM lineitem)
    SELECT kind, count(*) AS flags, count(DISTINCT item_id) AS proposals FROM f WHERE kind IS NOT NULL GROUP BY kind
    UNION ALL SELECT 'clean', 0, count(*) FROM orders WHERE o_orderkey NOT IN (SELECT item_id FROM f WHERE kind IS NOT NULL)""",
)
def triage_summary(t: Tables):
    kind = F.when(F.col("l_quantity") > 45, "overreach").when(F.col("l_discount") > 0.09, "duplicate").when(F.col("l_tax") > 0.075, "weak_anchor")
    flags = t.lineitem.select(F.col("l_orderkey").alias("item_id"), kind.alias("kind")).filter("kind IS NOT NULL")
    return O.triage_summary(flags, t.orders.select(F.col("o_orderkey").alias("item_id")))


@query(
    "queue_counts",
    f"""SELECT 'harvest' AS queue, count(*) AS n FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'extraction', count(*) FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT 'actionable', count_if({_STATUS_SQL} IN ('pending', 'edited')) FROM orders UNION ALL SELECT 'held', count_if(starts_with({_STATUS_SQL}, 'held')) FROM orders
    UNION ALL SELECT 'resumable', count_if(value > 50) FROM events""",
)
def queue_counts(t: Tables):
    queues = {"harvest": t.orders.filter("o_orderstatus = 'O'"), "extraction": t.orders.filter("o_orderstatus = 'P'")}
    return Q.queue_counts(queues, _proposals(t), t.events.select((F.col("value") > 50).alias("resumable")))


@query(
    "distinct_sources",
    "SELECT lang, count(DISTINCT source) AS contributing, count(DISTINCT source) FILTER (WHERE n_chars > 1000) AS with_long_texts FROM documents GROUP BY lang",
)
def distinct_sources(t: Tables):
    long_source = F.when(F.col("n_chars") > 1000, F.col("source"))
    return t.documents.groupBy("lang").agg(F.countDistinct("source").alias("contributing"), F.countDistinct(long_source).alias("with_long_texts"))


# --- windows and order --------------------------------------------------------------------
_CURVE_SQL = """curve AS (SELECT user_id AS topic_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step, event_id, floor(value) / 1000 AS rate FROM events)"""


def _curve(t: Tables):
    rows = t.events.select(F.col("user_id").alias("topic_id"), "event_id", (F.floor("value") / 1000).alias("novelty_rate"), F.floor("value").alias("added"))
    return prefix_scan(rows, ["topic_id"], [F.col("event_id")], position="step", sums={"cumulative_records": "added"})


ROLLING_SQL = f"""{_CURVE_SQL}, rolled AS (SELECT *, CASE WHEN count(*) OVER w = 10 THEN floor(sum(CAST(round(rate * 10000) AS BIGINT)) OVER w / 10 + 0.5) / 10000 END AS rolling_rate,
  sum(CAST(rate * 1000 + 0.5 AS BIGINT)) OVER (PARTITION BY topic_id ORDER BY step) AS cum FROM curve WINDOW w AS (PARTITION BY topic_id ORDER BY step ROWS 9 PRECEDING))"""


@query("rolling_novelty", f"WITH {ROLLING_SQL} SELECT topic_id, step, rolling_rate FROM rolled")
def rolling_novelty(t: Tables):
    return L.rolling_mean(_curve(t), ["topic_id"], "step", "novelty_rate", "rolling_rate", 10).select("topic_id", "step", "rolling_rate")


@query(
    "cumulative_records",
    "SELECT user_id AS topic_id, event_id, CAST(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS cumulative FROM events",
)
def cumulative_records(t: Tables):
    return _curve(t).select("topic_id", "event_id", F.col("cumulative_records").alias("cumulative"))


@query(
    "saturation_point",
    f"WITH {ROLLING_SQL} SELECT topic_id, min(step) FILTER (WHERE step >= 30 AND rolling_rate < 0.03) AS stop_step, max(step) AS last_step FROM rolled GROUP BY 1",
)
def saturation_point(t: Tables):
    rolled = L.rolling_mean(_curve(t), ["topic_id"], "step", "novelty_rate", "rolling_rate", 10)
    return L.saturation_point(rolled, 30, 0.03)


@query(
    "low_novelty_streak",
    """WITH w AS (SELECT user_id AS topic_id, event_type AS segment, strftime(ts, '%Y-%m-%d') AS week, bool_and(value < 40) AS low FROM events GROUP BY 1, 2, 3),
    l AS (SELECT topic_id, segment, max(week) FILTER (WHERE NOT low) AS last FROM w GROUP BY 1, 2)
    SELECT topic_id, segment, count_if(last IS NULL OR week > last) AS streak, min(week) FILTER (WHERE last IS NULL OR week > last) AS streak_since, count_if(low) AS low_attempts FROM w JOIN l USING (topic_id, segment) GROUP BY 1, 2""",
)
def low_novelty_streak(t: Tables):
    return L.low_novelty_streak(weekly_attempts(t), ["topic_id", "segment"])


def weekly_attempts(t: Tables):
    return t.events.groupBy(
        F.col("user_id").alias("topic_id"), F.col("event_type").alias("segment"), F.date_format("ts", "yyyy-MM-dd").alias("week")
    ).agg(F.bool_and(F.col("value") < 40).alias("low_novelty"))


@query(
    "rank_records",
    f"WITH {RECORDS_SQL} SELECT record_id, topic_id, row_number() OVER (PARTITION BY topic_id ORDER BY year % 3, coalesce(citations, -1) DESC, record_id) AS rank FROM records",
)
def rank_records(t: Tables):
    rows = records(t).select("record_id", "topic_id", (F.col("year") % 3).alias("tier"), F.coalesce("citations", F.lit(-1)).alias("cites"))
    ranked = prefix_scan(rows, ["topic_id"], [F.asc("tier"), F.desc("cites"), F.asc("record_id")], position="rank")
    return ranked.select("record_id", "topic_id", "rank")


@query(
    "first_occurrence",
    f"WITH {KEYED_SQL} SELECT title_key, min(query_index) AS first_query, count(DISTINCT query_index) AS queries FROM keyed WHERE title_key IS NOT NULL GROUP BY 1",
)
def first_occurrence(t: Tables):
    return keyed_records(t).filter("title_key IS NOT NULL").groupBy("title_key").agg(
        F.min("query_index").alias("first_query"), F.countDistinct("query_index").alias("queries")
    )


@query(
    "prefix_budget",
    "WITH s AS (SELECT lang, doc_id, sum(CAST(ceil(strlen(text) / 4.0) AS BIGINT)) OVER (PARTITION BY lang ORDER BY doc_id) AS spent FROM documents) SELECT lang, doc_id, CAST(spent AS BIGINT) AS spent FROM s WHERE spent <= 40000",
)
def prefix_budget(t: Tables):
    rows = t.documents.select("lang", "doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))
    spent = prefix_scan(rows, ["lang"], [F.col("doc_id")], sums={"spent": "tokens"})
    return spent.filter("spent <= 40000").select("lang", "doc_id", "spent")


@query(
    "top_per_category",
    f"""WITH {RECORDS_SQL}, c AS (SELECT record_id, year, citations, unnest({classify_sql(NOW_YEAR, DATA_MARKERS)}) AS category FROM records),
    r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY coalesce(citations, -1) DESC, year DESC, record_id) AS rank FROM c)
    SELECT category, record_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""",
)
def top_per_category(t: Tables):
    return Q.top_per_category(C.classify(records(t), NOW_YEAR, DATA_MARKERS), 5).select("category", "record_id", "rank")


@query("latest_runs", "SELECT event_id AS run_id, event_type AS corpus FROM events ORDER BY ts DESC, event_id LIMIT 20")
def latest_runs(t: Tables):
    return Q.latest_runs(_runs(t), 20).select("run_id", "corpus")


@query(
    "retain_last_runs",
    "SELECT event_id AS run_id, event_type AS corpus FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) <= 20",
)
def retain_last_runs(t: Tables):
    return Q.retain_last(_runs(t), ["corpus"], [F.desc("run_at"), F.asc("run_id")], 20).select("run_id", "corpus")


@query("first_marker", f"WITH {RECORDS_SQL} SELECT record_id, {fires_sql(_PROBE, DATA_MARKERS)}[1] AS marker FROM records")
def first_marker_query(t: Tables):
    text = F.concat("title", F.lit(" "), F.coalesce("abstract", F.lit("")))
    return records(t).select("record_id", first_marker(text, DATA_MARKERS).alias("marker"))


@query(
    "cells_changed",
    """WITH a AS (SELECT o_custkey AS pack, o_orderpriority AS segment, max(CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN o_orderstatus END) AS b, max(CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN o_orderstatus END) AS n FROM orders GROUP BY 1, 2)
    SELECT pack, segment, b AS status_before, n AS status_after FROM a WHERE b IS DISTINCT FROM n""",
)
def cells_changed(t: Tables):
    return Q.cells_changed(*_snapshots(t))


def _snapshots(t: Tables):
    cut = F.to_timestamp(F.lit("1998-01-01"))
    rows = t.orders.select(F.col("o_custkey").alias("pack"), F.col("o_orderpriority").alias("segment"), F.col("o_orderstatus").alias("status"), "o_orderdate")
    fold = lambda df: df.groupBy("pack", "segment").agg(F.max("status").alias("status"))
    return fold(rows.filter(F.col("o_orderdate") < cut)), fold(rows.filter(F.col("o_orderdate") >= cut))


@query(
    "corpus_order",
    f"WITH {RECORDS_SQL} SELECT record_id FROM records ORDER BY (record_id % 100 = 7) DESC, coalesce(citations, -1) DESC, record_id LIMIT 200",
)
def corpus_order(t: Tables):
    r = records(t).withColumn("source_api", F.when(F.col("record_id") % 100 == 7, "pinned").otherwise(F.col("source_api")))
    return Q.corpus_order(r, 200).select("record_id")


@query(
    "seeded_sample",
    "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('7:' || doc_id), doc_id) <= 15",
)
def seeded_sample(t: Tables):
    return Q.seeded_sample(t.documents.select("source", "doc_id"), ["source"], "doc_id", 15, 7)


@query(
    "strided_sample",
    """WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () AS total FROM orders)
    SELECT o_orderkey FROM n WHERE rn % greatest(1, total // 120) = 0 AND rn // greatest(1, total // 120) < 120""",
)
def strided_sample(t: Tables):
    return Q.strided_sample(t.orders.select("o_orderkey"), "o_orderkey", 120)


@query(
    "collated_order",
    f"WITH {RECORDS_SQL} SELECT topic_id, record_id, row_number() OVER (PARTITION BY topic_id ORDER BY title COLLATE en NULLS LAST, record_id) AS position FROM records",
)
def collated_order(t: Tables):
    titles = records(t).select("topic_id", "record_id", "title")
    return Q.collated_positions(titles, ["topic_id"], "title", "record_id").drop("title")


@query(
    "volume_cap",
    """WITH c AS (SELECT o_orderkey, o_custkey % 40 AS topic_id, o_totalprice / 500000 AS confidence FROM orders)
    SELECT o_orderkey, topic_id, CASE WHEN confidence < 0.5 THEN 'held_low_confidence' WHEN row_number() OVER (PARTITION BY topic_id, confidence >= 0.5 ORDER BY confidence DESC, o_orderkey) > 25 THEN 'dropped_volume_cap' ELSE 'proposed' END AS fate FROM c""",
)
def volume_cap(t: Tables):
    c = t.orders.select(
        F.col("o_orderkey").alias("candidate_id"),
        (F.col("o_custkey") % 40).alias("topic_id"),
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("identity"),
        (F.col("o_totalprice") / 500000).alias("confidence"),
        F.lit(None).cast("string").alias("gate_reason"),
        F.lit(True).alias("transferable"),
        F.lit(None).cast("string").alias("match_id"),
        F.lit(None).cast("string").alias("match_status"),
        F.lit(True).alias("adds_value"),
    )
    out = O.candidate_fate(c, 25)
    return out.select(F.col("candidate_id").alias("o_orderkey"), "topic_id", "fate")


# --- graph -------------------------------------------------------------------------------
REVIEWS_SQL = "reviews AS (SELECT o_orderkey AS review FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200)"
STATE_SQL = f"""{REVIEWS_SQL}, edges AS (SELECT DISTINCT l_orderkey AS review, l_partkey AS ref FROM lineitem WHERE l_orderkey IN (SELECT review FROM reviews)),
corpus AS (SELECT p_partkey FROM part WHERE p_size <= 20), names AS (SELECT DISTINCT p_name || p_type AS nm FROM part WHERE p_size <= 20 AND p_partkey % 7 = 0),
state AS (SELECT review, ref, ref IN (SELECT p_partkey FROM corpus) OR p_retailprice < 1000 AS is_resolved,
  ref IN (SELECT p_partkey FROM corpus) OR (p_retailprice < 1000 AND p_name || p_type IN (SELECT nm FROM names)) AS in_corpus FROM edges JOIN part ON p_partkey = ref)"""


def _reference_state(t: Tables):
    """The dearest orders as reviews, their parts as references, small parts as corpus."""
    orders = t.orders.select(F.col("o_orderkey").alias("record_id"), F.col("o_totalprice").alias("citations"))
    reviews = K.top_reviews(orders, F.lit(True), 200).select(F.col("record_id").alias("review"))
    edges = (
        t.lineitem.select(F.col("l_orderkey").alias("review"), F.col("l_partkey").alias("ref"))
        .join(F.broadcast(reviews), "review", "left_semi")  # at most 200 rows
        .distinct()
    )
    name = F.concat("p_name", "p_type").alias("name")
    resolved_meta = t.part.filter("p_retailprice < 1000").select(F.col("p_partkey").alias("ref"), name)
    small = t.part.filter("p_size <= 20")
    corpus = small.select(F.col("p_partkey").alias("ref"), F.when(F.col("p_partkey") % 7 == 0, F.concat("p_name", "p_type")).alias("name"))
    return K.reference_state(edges, resolved_meta, corpus, ["name"])


@query(
    "review_coverage",
    f"""WITH {STATE_SQL} SELECT review, count(*) AS references_total, count_if(is_resolved) AS references_resolved, count_if(in_corpus) AS references_in_corpus,
    CASE WHEN count_if(is_resolved) > 0 THEN {R4.format('count_if(in_corpus) / count_if(is_resolved)')} END AS coverage FROM state GROUP BY 1""",
)
def review_coverage(t: Tables):
    return K.review_coverage(_reference_state(t))


@query(
    "shared_references",
    f"WITH {STATE_SQL} SELECT ref, count(DISTINCT review) AS reviews FROM state WHERE is_resolved AND NOT in_corpus GROUP BY 1 HAVING count(DISTINCT review) >= 2",
)
def shared_references(t: Tables):
    return K.shared_references(_reference_state(t))


@query(
    "expand_anchors",
    """WITH c AS (SELECT o_orderkey AS anchor FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000 ORDER BY o_orderkey LIMIT 20),
    e AS (SELECT DISTINCT l_orderkey AS anchor, 'backward' AS direction, l_partkey AS neighbour FROM lineitem JOIN c ON anchor = l_orderkey)
    SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY anchor, direction ORDER BY neighbour) <= 25""",
)
def expand_anchors(t: Tables):
    candidates = t.orders.filter("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("anchor"), F.col("o_orderkey").alias("seq"), (F.col("o_totalprice") > 400000).alias("topical")
    )
    # Parts live in another id space, so shifting them keeps the two directions apart.
    edges = t.lineitem.select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") + 10**12).alias("dst"))
    out = K.expand_anchors(candidates, edges)
    return out.withColumn("neighbour", F.col("neighbour") - 10**12)


@query(
    "anchor_counters",
    f"SELECT count(*) AS candidates, count_if(o_totalprice > 400000) AS confirmed, count_if(o_totalprice <= 400000) AS rejected, {R4.format('count_if(o_totalprice > 400000) / count(*)')} AS confirmation_rate FROM orders",
)
def anchor_counters(t: Tables):
    return K.anchor_counters(t.orders.select((F.col("o_totalprice") > 400000).alias("topical")))


def trade_edges(t: Tables):
    """Nation pairs (supplier's, customer's) joined by expensive order lines."""
    lines = t.lineitem.filter("l_quantity = 50 AND l_extendedprice > 90000").select("l_orderkey", "l_suppkey")
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    cust = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("b"))
    supp = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("a"))
    return lines.join(orders, "l_orderkey").join(cust, "o_custkey").join(supp, "l_suppkey").select("a", "b").distinct()


def pack_members(t: Tables):
    return t.nation.select(F.col("n_regionkey").alias("pack"), F.col("n_nationkey").alias("topic_id"))


PAIRS_SQL = """trade AS (SELECT DISTINCT least(s_nationkey, c_nationkey) AS a, greatest(s_nationkey, c_nationkey) AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity = 50 AND l_extendedprice > 90000 AND s_nationkey <> c_nationkey),
linked AS (SELECT x.n_regionkey AS pack, a, b FROM trade JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b AND y.n_regionkey = x.n_regionkey),
missing AS (SELECT x.n_regionkey AS pack, x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey
  WHERE (x.n_nationkey, y.n_nationkey) NOT IN (SELECT (a, b) FROM linked))"""


@query(
    "interaction_coverage",
    f"""WITH {PAIRS_SQL}, m AS (SELECT n_regionkey AS pack, count(*) AS members FROM nation GROUP BY 1), l AS (SELECT pack, count(*) AS connected FROM linked GROUP BY 1)
    SELECT pack, members, coalesce(connected, 0) AS connected, coalesce(connected, 0) / (members * (members - 1) / 2) AS coverage FROM m LEFT JOIN l USING (pack)""",
)
def interaction_coverage(t: Tables):
    return K.interaction_coverage(pack_members(t), trade_edges(t))


@query("missing_pairs", f"WITH {PAIRS_SQL} SELECT pack, a, b FROM missing")
def missing_pairs(t: Tables):
    return K.missing_pairs(pack_members(t), trade_edges(t))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
CELL_IMPORTANCE_SQL = f"cells AS (SELECT n_regionkey AS pack, c_mktsegment AS segment, {R4.format('count_if(c_acctbal < 1000) / count(*)')} AS importance FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)"


def cell_importance(t: Tables):
    nation = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("pack"))
    share = F.count_if(F.col("c_acctbal") < 1000) / F.count(F.lit(1))
    return t.customer.join(nation, "c_nationkey").groupBy("pack", F.col("c_mktsegment").alias("segment")).agg(S.round4(share).alias("importance"))


@query(
    "pair_backlog",
    f"""WITH {PAIRS_SQL}, {CELL_IMPORTANCE_SQL} SELECT CAST(a AS VARCHAR) || '|' || CAST(b AS VARCHAR) AS pair, max(importance) AS importance, count(*) AS cells, a % 4 = 0 AS authored
    FROM (SELECT pack, CASE WHEN CAST(a AS VARCHAR) < CAST(b AS VARCHAR) THEN a ELSE b END AS a, CASE WHEN CAST(a AS VARCHAR) < CAST(b AS VARCHAR) THEN b ELSE a END AS b FROM missing) JOIN cells USING (pack) GROUP BY 1, a, b""",
)
def pair_backlog(t: Tables):
    named = K.missing_pairs(pack_members(t), trade_edges(t)).select("pack", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    authored = named.filter(F.least("a", "b").cast("int") % 4 == 0).select("a", "b")
    return K.pair_backlog(cell_importance(t), named, authored)


@query(
    "pack_interactions",
    f"""WITH {PAIRS_SQL}, g AS (SELECT n_nationkey AS k, n_nationkey % 9 AS r FROM nation), own AS (SELECT pack, a, b FROM linked WHERE (a + b) % 3 = 0)
    SELECT pack, a, b, 'reinforcing' AS kind, 'B' AS grade, 'authored' AS origin FROM own
    UNION ALL SELECT pack, a, b, 'sequence-amplifying', ['A+','A','A-','B+','B','B-','C+','C','C-'][1 + greatest(a % 9, b % 9)], 'relation' FROM linked WHERE (a + b) % 3 <> 0""",
)
def pack_interactions(t: Tables):
    members = pack_members(t)
    linked = K.connected_pairs(members, trade_edges(t))
    authored = linked.filter((F.col("a") + F.col("b")) % 3 == 0).select(
        "a", "b", F.lit("reinforcing").alias("type"), F.lit("fact").alias("fact"), F.lit("B").alias("grade")
    )
    relations = linked.select(
        F.col("b").alias("src"), F.col("a").alias("dst"), F.lit("enabled_by").alias("type"), F.lit("note").alias("note"), F.lit(1).alias("seq")
    )
    from corroborate.functions.vocabulary import GRADES

    grades = t.nation.select(F.col("n_nationkey").alias("topic_id"), F.get(X.literals(GRADES), F.col("n_nationkey") % 9).alias("grade"))
    return K.pack_interactions(members, authored, relations, grades).drop("fact")


# --- novelty -----------------------------------------------------------------------------
def hits(t: Tables):
    return resolved(t).select("topic_id", (F.col("query_index") + 1).alias("query_index"), "cluster")


_CURVE2_SQL = f"""{CLUSTER_SQL.strip()},
h AS (SELECT topic_id, query_index + 1 AS query_index, cluster_id FROM keyed JOIN cluster USING (record_id)),
q AS (SELECT topic_id, query_index, count(*) AS returned, count(DISTINCT cluster_id) AS unique_returned FROM h GROUP BY 1, 2),
f AS (SELECT topic_id, cluster_id, min(query_index) AS query_index FROM h GROUP BY 1, 2),
a AS (SELECT topic_id, query_index, count(*) AS added FROM f GROUP BY 1, 2),
c AS (SELECT topic_id, query_index, returned, unique_returned, coalesce(added, 0) AS records_added, {R4.format('coalesce(added, 0) / unique_returned')} AS novelty_rate FROM q LEFT JOIN a USING (topic_id, query_index)),
curve AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY query_index) AS step, CAST(sum(records_added) OVER (PARTITION BY topic_id ORDER BY query_index) AS BIGINT) AS cumulative_records,
  CASE WHEN count(*) OVER w = 5 THEN floor(sum(CAST(floor(novelty_rate * 10000 + 0.5) AS BIGINT)) OVER w / 5 + 0.5) / 10000 END AS rolling_rate FROM c WINDOW w AS (PARTITION BY topic_id ORDER BY query_index ROWS 4 PRECEDING))"""


@query(
    "novelty_curve",
    f"WITH RECURSIVE {_CURVE2_SQL} SELECT topic_id, query_index, returned, unique_returned, records_added, novelty_rate, cumulative_records, step, rolling_rate FROM curve",
)
def novelty_curve(t: Tables):
    return L.novelty_curve(hits(t), 5)


@query(
    "novelty_report",
    f"""WITH {_HALVES}, k AS (SELECT count(*) AS u, count_if({MATCH_SQL}) AS known FROM cur)
    SELECT (SELECT count(*) FROM prev) AS previous_records, u AS unique_records, known AS already_known, u - known AS new_records, {R4.format('(u - known) / u')} AS novelty_rate, known / u > 0.8 AS low_novelty FROM k""",
)
def novelty_report(t: Tables):
    current, previous = halves(t)
    return L.novelty_report(current, previous, "record_id", ["doi", "openalex_id", "title_key"])


@query(
    "spread_report",
    f"""WITH RECURSIVE {CLUSTER_SQL}, q AS (SELECT source_api, query_index, count(*) AS returned FROM keyed GROUP BY 1, 2)
    SELECT source_api, count(*) AS queries, CAST(sum(returned) AS BIGINT) AS returned, (SELECT count(DISTINCT cluster_id) FROM keyed k JOIN cluster USING (record_id) WHERE k.source_api = q.source_api) AS unique_records FROM q GROUP BY 1""",
)
def spread_report(t: Tables):
    issued = keyed_records(t).groupBy("source_api", "query_index").agg(F.count(F.lit(1)).alias("returned"))
    return L.spread_report(issued, resolved(t), "source_api")


@query(
    "recency",
    f"WITH {RECORDS_SQL} SELECT count_if(year >= {NOW_YEAR - 5}) AS recent_records, {R4.format(f'count_if(year >= {NOW_YEAR - 5}) / count(*)')} AS recency_rate FROM records",
)
def recency(t: Tables):
    return L.recency(records(t), NOW_YEAR)


@query(
    "field_estimate",
    f"""WITH RECURSIVE {CLUSTER_SQL}, q AS (SELECT source_api || ':' || topic_id AS scope, CASE WHEN query_index % 4 <> 0 THEN count(*) * 100 + query_index END AS total FROM keyed GROUP BY source_api, topic_id, query_index),
    m AS (SELECT scope, max(total) AS total FROM q WHERE total IS NOT NULL GROUP BY 1),
    h AS (SELECT DISTINCT source_api || ':' || topic_id AS scope, cluster_id FROM keyed JOIN cluster USING (record_id)),
    o AS (SELECT count(*) AS mem, count(DISTINCT cluster_id) AS uni FROM h WHERE scope IN (SELECT scope FROM m)), s AS (SELECT count(*) AS n, sum(total) AS total FROM m)
    SELECT CAST(greatest((SELECT count(DISTINCT cluster_id) FROM cluster), floor(total / (mem / uni) + 0.5)) AS BIGINT) AS estimate, n AS measured_scopes, CAST(total AS BIGINT) AS summed_results, {R4.format('mem / uni')} AS multiplicity FROM o, s""",
)
def field_estimate(t: Tables):
    scope = F.concat_ws(":", "source_api", "topic_id").alias("scope")
    r = keyed_records(t)
    issued = r.groupBy(scope, "query_index").agg(F.count(F.lit(1)).alias("n"))
    issued = issued.withColumn("total", F.when(F.col("query_index") % 4 != 0, F.col("n") * 100 + F.col("query_index")))
    found = resolved(t).select(scope, "cluster")
    return L.field_estimate(issued, found, found.agg(F.countDistinct("cluster").alias("corpus")))


@query(
    "saturation_report",
    f"""WITH RECURSIVE {_CURVE2_SQL}, s AS (SELECT topic_id, min(step) FILTER (WHERE step >= 8 AND rolling_rate < 0.8) AS stop_step FROM curve GROUP BY 1),
    kk AS (SELECT topic_id, max(cumulative_records) AS records, count(*) AS queries_issued FROM curve JOIN s USING (topic_id) WHERE stop_step IS NULL OR step <= stop_step GROUP BY 1)
    SELECT topic_id, queries_issued, records, stop_step, CASE WHEN stop_step IS NOT NULL THEN 'saturation' WHEN records >= 90 THEN 'storage_tier_record_cap' ELSE 'call_cap' END AS stop_reason FROM kk JOIN s USING (topic_id)""",
)
def saturation_report(t: Tables):
    return L.stop_reason(L.novelty_curve(hits(t), 5), 8, 0.8, 90)


@query(
    "novelty_exact",
    f"""WITH RECURSIVE {CLUSTER_SQL}, ts AS (SELECT unnest(range(1, 21)) AS t),
    kk AS (SELECT t, key, k.record_id FROM k JOIN keyed USING (record_id) JOIN ts ON query_index + 1 <= t),
    s2 AS (SELECT t, key, min(record_id) AS c FROM kk GROUP BY 1, 2),
    e2 AS (SELECT DISTINCT t, record_id AS a, c AS b FROM kk JOIN s2 USING (t, key) UNION SELECT DISTINCT t, c, record_id FROM kk JOIN s2 USING (t, key)),
    r2 AS (SELECT t, record_id AS node, record_id AS label FROM keyed JOIN ts ON query_index + 1 <= t UNION SELECT r.t, e.b, r.label FROM r2 r JOIN e2 e ON e.t = r.t AND e.a = r.node),
    n2 AS (SELECT t, count(DISTINCT l) AS c FROM (SELECT t, node, min(label) AS l FROM r2 GROUP BY 1, 2) GROUP BY 1)
    SELECT CAST(t AS INTEGER) AS step, c - lag(c, 1, 0) OVER (ORDER BY t) AS records_added FROM n2""",
)
def novelty_exact(t: Tables):
    rows = keyed_records(t).withColumn("step", F.col("query_index") + 1)
    return L.exact_added(rows, "record_id", ["doi", "openalex_id", "title_key"], "step")


@query(
    "novelty_exact_by_topic",
    f"""WITH RECURSIVE {CLUSTER_SQL}, ts AS (SELECT unnest(range(0, 20)) AS t),
    kk AS (SELECT topic_id, t, key, k.record_id FROM k JOIN keyed USING (record_id) JOIN ts ON query_index <= t),
    s2 AS (SELECT topic_id, t, key, min(record_id) AS c FROM kk GROUP BY 1, 2, 3),
    e2 AS (SELECT DISTINCT t, record_id AS a, c AS b FROM kk JOIN s2 USING (topic_id, t, key) UNION SELECT DISTINCT t, c, record_id FROM kk JOIN s2 USING (topic_id, t, key)),
    r2 AS (SELECT topic_id, t, record_id AS node, record_id AS label FROM keyed JOIN ts ON query_index <= t UNION SELECT r.topic_id, r.t, e.b, r.label FROM r2 r JOIN e2 e ON e.t = r.t AND e.a = r.node),
    n2 AS (SELECT topic_id, t, count(DISTINCT l) AS c FROM (SELECT topic_id, t, node, min(label) AS l FROM r2 GROUP BY 1, 2, 3) GROUP BY 1, 2),
    d AS (SELECT topic_id, t, c - lag(c, 1, 0) OVER (PARTITION BY topic_id ORDER BY t) AS records_added FROM n2)
    SELECT topic_id, CAST(t AS INTEGER) AS step, records_added FROM d WHERE t > 0 AND EXISTS (SELECT 1 FROM keyed q WHERE q.topic_id = d.topic_id AND q.query_index = d.t)""",
)
def novelty_exact_by_topic(t: Tables):
    """The records of query 0 were known before; the others count by their topic."""
    r = keyed_records(t)
    rows = r.filter("query_index > 0").withColumn("step", F.col("query_index"))
    return L.exact_added(rows, "record_id", ["doi", "openalex_id", "title_key"], "step", "topic_id", r.filter("query_index = 0"))


@query(
    "topic_digest",
    f"""WITH {RECORDS_SQL}, c AS (SELECT topic_id, record_id, citations, year, {classify_sql(NOW_YEAR, DATA_MARKERS)} AS cats FROM records),
    t AS (SELECT topic_id, record_id, citations, year, unnest(cats) AS category FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY topic_id, category ORDER BY coalesce(citations, -1) DESC, year DESC, record_id) AS rn FROM t),
    s AS (SELECT topic_id, count(*) AS records, count_if(len(cats) = 0) AS untagged FROM c GROUP BY 1)
    SELECT topic_id, category, record_id, CAST(rn AS INTEGER) AS rank, records, untagged FROM r JOIN s USING (topic_id) WHERE rn <= 3""",
)
def topic_digest(t: Tables):
    tagged = C.classify(records(t), NOW_YEAR, DATA_MARKERS)
    stats = tagged.groupBy("topic_id").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.size("categories") == 0).alias("untagged"))
    from pyspark.sql import Window

    order = Window.partitionBy("topic_id", "category").orderBy(F.desc(F.coalesce("citations", F.lit(-1))), F.desc("year"), F.asc("record_id"))
    flat = tagged.select("topic_id", "record_id", "citations", "year", F.explode("categories").alias("category"))
    top = flat.withColumn("rank", F.row_number().over(order)).filter("rank <= 3")
    return top.join(stats, "topic_id").select("topic_id", "category", "record_id", "rank", "records", "untagged")
