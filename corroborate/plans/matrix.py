"""Sufficiency matrix and work planning over nations (topics) and regions (packs)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from corroborate.functions import scalars as S
from corroborate.functions import text as X
from corroborate.functions import vocabulary as V
from corroborate.operators import matrix as M
from corroborate.operators import planning as N
from corroborate.plans.analytics import R4, interaction_coverage, low_novelty_streak
from corroborate.plans.analytics import PAIRS_SQL
from corroborate.plans.evidence import AFFINITY_SQL, HITS_SQL, TIER_SQL, tiered
from corroborate.plans.registry import Tables, query
from corroborate.plans.views import RECORDS_SQL

STAGES = ["cold_acquisition", "onboarding", "activation", "conversion", "retention", "reactivation"]
SEGMENTS = {
    "AUTOMOBILE": ["cold_acquisition", "conversion", "reactivation"],
    "BUILDING": ["conversion", "retention"],
    "FURNITURE": ["activation", "conversion"],
    "HOUSEHOLD": ["cold_acquisition", "activation", "retention"],
}
UNCONFIGURED = ["MACHINERY"]
GRADE_WEIGHTS = {"A": 1.0, "B": 0.7, "C": 0.4}
THRESHOLDS = V.SEED_THRESHOLDS
K_WEEKS = 1

_ST = "['cold_acquisition','onboarding','activation','conversion','retention','reactivation']"
_SEG = "seg AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{s}', [{', '.join(repr(x) for x in stages)}])" for s, stages in SEGMENTS.items()
) + ") v(segment, stages))"
_GR = "[" + ", ".join(f"'{g}'" for g in V.GRADES) + "]"

TOPICS_SQL = f"""{_SEG},
cs AS (SELECT c_nationkey AS n, count(*) AS customers, count_if(c_acctbal > 5000) AS rich, count_if(c_acctbal > 0) AS solvent FROM customer GROUP BY 1),
ss AS (SELECT s_nationkey AS n, count(*) AS suppliers FROM supplier GROUP BY 1),
topics AS (SELECT n_nationkey AS topic_id, n_regionkey AS pack, CASE WHEN n_nationkey % 4 <> 3 THEN rich * 2 > customers END AS saturated,
  coalesce(customers, 0) AS records, CASE WHEN n_nationkey % 7 <> 0 THEN coalesce(suppliers, 0) * 20 END AS estimate, n_nationkey % 3 AS contributing,
  {R4.format('rich / customers')} AS recency_rate, coalesce(suppliers, 0) % 4 AS effects, n_nationkey % 5 AS realizations, coalesce(customers, 0) AS current_records,
  coalesce(solvent, 0) AS processed_records, n_nationkey % 6 <> 0 AS has_ledger, {_GR}[1 + n_nationkey % 9] AS grade,
  CASE WHEN n_nationkey % 5 <> 0 THEN 'contested' ELSE ' ' END AS dissent, n_nationkey % 8 = 0 AS flagged,
  [{_ST}[1 + n_nationkey % 6], {_ST}[1 + (n_nationkey + 2) % 6]] AS funnel_stages, [{_ST}[1 + (n_nationkey + 3) % 6]] AS excluded_stages
  FROM nation LEFT JOIN cs ON cs.n = n_nationkey LEFT JOIN ss ON ss.n = n_nationkey)"""


def topics(t: Tables):
    n = F.col("n_nationkey")
    customers = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("c_acctbal") > 5000).alias("rich"),
        F.count_if(F.col("c_acctbal") > 0).alias("solvent"),
    )
    suppliers = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    stages = X.literals(STAGES)
    at = lambda k: F.get(stages, ((n + k) % 6).cast("int"))
    zero = F.lit(0)
    return t.nation.join(customers, "n_nationkey", "left").join(suppliers, "n_nationkey", "left").select(
        n.alias("topic_id"),
        F.col("n_regionkey").alias("pack"),
        F.when(n % 4 != 3, F.col("rich") * 2 > F.col("customers")).alias("saturated"),
        F.coalesce("customers", zero).alias("records"),
        F.when(n % 7 != 0, F.coalesce("suppliers", zero) * 20).alias("estimate"),
        F.lit(None).cast("bigint").alias("estimate_override"),
        (n % 3).alias("contributing"),
        S.round4(F.col("rich") / F.col("customers")).alias("recency_rate"),
        (F.coalesce("suppliers", zero) % 4).alias("effects"),
        (n % 5).alias("realizations"),
        F.coalesce("customers", zero).alias("current_records"),
        F.coalesce("solvent", zero).alias("processed_records"),
        (n % 6 != 0).alias("has_ledger"),
        F.get(X.literals(V.GRADES), n % 9).alias("grade"),
        F.when(n % 5 != 0, "contested").otherwise(" ").alias("dissent"),
        (n % 8 == 0).alias("flagged"),
        F.array(at(0), at(2)).alias("funnel_stages"),
        F.array(at(3)).alias("excluded_stages"),
    )


def affinity(t: Tables):
    names = X.literals(list(SEGMENTS))
    n = F.col("n_nationkey")
    return t.nation.filter(n % 10 == 1).select(
        F.get(names, n % 4).alias("segment"), n.alias("topic_id"), F.lit(1.5).alias("boost")
    )


_NAMES = "[" + ", ".join(f"'{s}'" for s in SEGMENTS) + "]"
WEIGHTS_SQL = f"""{TOPICS_SQL},
aff AS (SELECT {_NAMES}[1 + n_nationkey % 4] AS segment, n_nationkey AS topic_id, CAST(1.5 AS DOUBLE) AS boost FROM nation WHERE n_nationkey % 10 = 1),
w AS (SELECT topics.*, seg.segment, seg.stages, CAST(least(1.0, CASE WHEN list_has_any(funnel_stages, stages) THEN 1.0 ELSE 0.5 END * coalesce(boost, 1.0)) AS DOUBLE) AS weight, boost IS NOT NULL AS has_affinity
  FROM topics CROSS JOIN seg LEFT JOIN aff ON aff.topic_id = topics.topic_id AND aff.segment = seg.segment)"""


def weights(t: Tables):
    return t.once("weights", _weights)


def _weights(t: Tables):
    full = topics(t)
    return M.member_weights(full.select("pack", "topic_id"), full.drop("pack"), SEGMENTS, affinity(t))


@query("member_weights", f"WITH {WEIGHTS_SQL} SELECT pack, segment, topic_id, weight, has_affinity FROM w")
def member_weights(t: Tables):
    return weights(t).select("pack", "segment", "topic_id", "weight", "has_affinity")


def _mean(expr: str) -> str:
    return f"CASE WHEN count({expr}) = count(*) THEN floor(avg({expr}) * 10000 + 0.5) / 10000 END"


_VALUES = {
    "saturation_reached": "CASE WHEN saturated THEN 1.0 WHEN NOT saturated THEN 0.0 END",
    "corpus_size_vs_field_estimate": "CASE WHEN estimate > 0 THEN least(1.0, records / estimate) END",
    "source_diversity": "least(1.0, contributing / 2)",
    "recency_balance": "recency_rate",
    "effect_coverage": "least(1.0, effects / 2)",
    "realization_density": "least(1.0, realizations / 3)",
    "extraction_completeness": "CASE WHEN has_ledger AND current_records > 0 THEN processed_records / current_records END",
}
PACK_SQL = f"{WEIGHTS_SQL}, ps AS (" + " UNION ALL ".join(
    f"SELECT pack, '{c}' AS criterion, CAST({_mean(f'CAST({e} AS DOUBLE)')} AS DOUBLE) AS score FROM topics GROUP BY pack" for c, e in _VALUES.items()
) + ")"


def pack_scores(t: Tables):
    full = topics(t)
    return M.pack_scores(full.select("pack", "topic_id"), M.topic_scores(full))


@query("breadth_depth_scores", f"WITH {PACK_SQL} SELECT pack, criterion, score FROM ps")
def breadth_depth_scores(t: Tables):
    return pack_scores(t)


_GW = "CASE substr(grade, 1, 1) WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.7 ELSE 0.4 END"
QUALITY_SQL = f"""qs AS (SELECT pack, segment, 'dissent_completeness' AS criterion, {R4.format("count_if(trim(dissent) <> '') / count(*)")} AS score FROM w GROUP BY 1, 2
  UNION ALL SELECT pack, segment, 'grade_sufficiency', {R4.format(f'sum(weight * CAST({_GW} AS DOUBLE)) / sum(weight)')} FROM w GROUP BY 1, 2
  UNION ALL SELECT pack, segment, 'freshness', {R4.format('1 - sum(weight * CASE WHEN flagged THEN 1 ELSE 0 END) / sum(weight)')} FROM w GROUP BY 1, 2),
unc AS (SELECT DISTINCT pack, segment, stage FROM (SELECT pack, segment, unnest(stages) AS stage FROM w) x WHERE NOT EXISTS (SELECT 1 FROM w y WHERE y.pack = x.pack AND y.segment = x.segment
  AND list_position({_GR}, y.grade) <= 5 AND list_contains(y.funnel_stages, x.stage) AND NOT list_contains(y.excluded_stages, x.stage))),
cc AS (SELECT s.pack, s.segment, 'context_coverage' AS criterion, {R4.format('1 - coalesce(m, 0) / wanted')} AS score FROM (SELECT pack, segment, max(len(stages)) AS wanted FROM w GROUP BY 1, 2) s
  LEFT JOIN (SELECT pack, segment, count(*) AS m FROM unc GROUP BY 1, 2) u ON u.pack = s.pack AND u.segment = s.segment)"""


@query("quality_scores", f"WITH {PACK_SQL}, {QUALITY_SQL} SELECT * FROM qs")
def quality_scores(t: Tables):
    return M.quality_scores(weights(t), GRADE_WEIGHTS)


@query("context_coverage", f"WITH {PACK_SQL}, {QUALITY_SQL} SELECT * FROM cc")
def context_coverage(t: Tables):
    return M.context_coverage(weights(t))


@query("uncovered_stages", f"WITH {PACK_SQL}, {QUALITY_SQL} SELECT * FROM unc")
def uncovered_stages(t: Tables):
    return M.uncovered_stages(weights(t))


_IC = f"""{PAIRS_SQL}, ic AS (SELECT pack, 'interaction_coverage' AS criterion, {R4.format('coalesce(connected, 0) / (members * (members - 1) / 2)')} AS score
  FROM (SELECT n_regionkey AS pack, count(*) AS members FROM nation GROUP BY 1) m LEFT JOIN (SELECT pack, count(*) AS connected FROM linked GROUP BY 1) l USING (pack))"""


def _case(values: dict, default) -> str:
    return "CASE criterion " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items() if k != "default") + f" ELSE {default!r} END"


JUDGED_SQL = f"""{PACK_SQL}, {QUALITY_SQL}, {_IC},
raw AS (SELECT pack, segment, criterion, score FROM qs UNION ALL SELECT pack, segment, criterion, score FROM cc
  UNION ALL SELECT ps.pack, segment, criterion, score FROM ps, seg UNION ALL SELECT ic.pack, segment, criterion, score FROM ic, seg),
th AS (SELECT *, CAST({_case({k: v[0] for k, v in THRESHOLDS.items()}, THRESHOLDS['default'][0])} AS DOUBLE) AS green, CAST({_case({k: v[1] for k, v in THRESHOLDS.items()}, THRESHOLDS['default'][1])} AS DOUBLE) AS amber,
  {_case(M.FIX_TYPES, '')} AS fix_type, {_case(M.GROUPS, '')} AS criterion_group FROM raw),
judged AS (SELECT *, CASE WHEN score IS NULL THEN 'red' WHEN score >= green THEN 'green' WHEN score >= amber THEN 'amber' ELSE 'red' END AS criterion_status FROM th)"""


def judged(t: Tables):
    """The matrix is read by statuses, gaps and every queue, so it is written once."""
    return t.once("judged", _judged)


def _judged(t: Tables):
    """All twelve scores of every configured cell with thresholds and statuses."""
    w = weights(t)
    segments = list(SEGMENTS)
    fan = F.explode(X.literals(segments)).alias("segment")
    pairs = interaction_coverage(t).select("pack", F.lit("interaction_coverage").alias("criterion"), S.round4(F.col("coverage")).alias("score"))
    shared = pack_scores(t).unionByName(pairs).select("pack", fan, "criterion", "score")
    parts = [M.quality_scores(w, GRADE_WEIGHTS), M.context_coverage(w), shared]
    cells = reduce(lambda a, b: a.unionByName(b), parts)
    return M.with_thresholds(cells, THRESHOLDS)


@query("cell_scores", f"WITH {JUDGED_SQL} SELECT pack, segment, criterion, score, criterion_status, fix_type, criterion_group FROM judged")
def cell_scores(t: Tables):
    return judged(t).select("pack", "segment", "criterion", "score", "criterion_status", "fix_type", "criterion_group")


_RANK = "CASE criterion_status WHEN 'red' THEN 2 WHEN 'amber' THEN 1 ELSE 0 END"


def _group(name: str) -> str:
    return f"""CASE WHEN bool_or(criterion_group = '{name}' AND score IS NULL) THEN 'unmeasured' ELSE ['green', 'amber', 'red'][1 + max({_RANK}) FILTER (WHERE criterion_group = '{name}')] END AS {name}_status"""


_GAPS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN bool_or(criterion = '{c}' AND criterion_status <> 'green') THEN '{c}' END" for c in M.CRITERION_NAMES) + "], lambda g: g IS NOT NULL), ',')"
CELLS_SQL = f"""{JUDGED_SQL}, cells AS (SELECT pack, segment, ['green', 'amber', 'red'][1 + max({_RANK})] AS status, {_GAPS} AS gaps, {_group('breadth')}, {_group('depth')}, {_group('quality')} FROM judged GROUP BY 1, 2)"""


@query("cell_status", f"WITH {CELLS_SQL} SELECT * FROM cells")
def cell_status(t: Tables):
    return M.cell_status(judged(t)).withColumn("gaps", F.array_join("gaps", ","))


GAPS_SQL = f"""{CELLS_SQL}, ev AS (SELECT pack, segment, CASE WHEN bool_or(has_affinity) THEN 'segment_specific' ELSE 'general_only' END AS segment_evidence FROM w GROUP BY 1, 2),
tg AS (SELECT pack, segment, criterion, score AS value, green AS threshold, fix_type FROM judged WHERE criterion_status <> 'green'
  UNION ALL SELECT pack, segment, 'segment_evidence', 0, 1, 'harvest' FROM cells JOIN ev USING (pack, segment) WHERE segment_evidence = 'general_only' AND status <> 'green')"""


def gaps(t: Tables):
    j = judged(t)
    cells = M.cell_status(j).join(M.segment_evidence(weights(t)), ["pack", "segment"])
    return M.typed_gaps(j, cells)


@query("typed_gaps", f"WITH {GAPS_SQL} SELECT * FROM tg")
def typed_gaps(t: Tables):
    return gaps(t)


@query(
    "bootstrap_cells",
    f"""WITH r AS (SELECT DISTINCT n_regionkey AS pack FROM nation), c AS (SELECT unnest([{', '.join(f"'{c}'" for c in M.CRITERION_NAMES)}]) AS criterion)
    SELECT pack, 'MACHINERY' AS segment, criterion, CAST(NULL AS DOUBLE) AS score, 'red' AS criterion_status FROM r, c""",
)
def bootstrap_cells(t: Tables):
    packs = t.nation.select(F.col("n_regionkey").alias("pack")).distinct()
    cells = M.with_thresholds(M.bootstrap_cells(packs, UNCONFIGURED), THRESHOLDS)
    return cells.select("pack", "segment", "criterion", "score", "criterion_status")


_CAND = "cand AS (SELECT n_regionkey AS pack, count(DISTINCT n_name) AS candidate_members FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 2500) GROUP BY 1)"


def _seed_members(t: Tables):
    active = t.supplier.filter("s_acctbal > 2500").select(F.col("s_nationkey").alias("n_nationkey"))
    return t.nation.join(active, "n_nationkey", "left_anti").select(
        F.col("n_regionkey").alias("pack"), F.col("n_name").alias("topic_id"), F.col("n_nationkey").alias("key")
    )


@query(
    "candidate_pendency",
    f"""WITH {CELLS_SQL}, {_CAND} SELECT pack, segment, gaps, CASE WHEN candidate_members IS NOT NULL THEN 'red' ELSE status END AS status,
    CASE WHEN candidate_members IS NOT NULL THEN 'red' ELSE breadth_status END AS breadth_status, CASE WHEN candidate_members IS NOT NULL THEN 'red' ELSE depth_status END AS depth_status,
    CASE WHEN candidate_members IS NOT NULL THEN 'red' ELSE quality_status END AS quality_status, coalesce(candidate_members, 0) AS candidate_members FROM cells LEFT JOIN cand USING (pack)""",
)
def candidate_pendency(t: Tables):
    out = M.candidate_pendency(M.cell_status(judged(t)), _seed_members(t))
    return out.withColumn("gaps", F.array_join("gaps", ","))


# Weekly attempts of customers' orders per nation and segment: a cheap week is low-novelty.
_STREAK = f"""att AS (SELECT c_nationkey AS topic_id, c_mktsegment AS segment, strftime(o_orderdate, '%Y-%m') AS week, avg(o_totalprice) < 330000 AS low FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3),
lastn AS (SELECT topic_id, segment, max(week) FILTER (WHERE NOT low) AS last FROM att GROUP BY 1, 2),
streaks AS (SELECT topic_id, segment, count_if(last IS NULL OR week > last) AS streak, min(week) FILTER (WHERE last IS NULL OR week > last) AS streak_since, count_if(low) AS low_attempts FROM att JOIN lastn USING (topic_id, segment) GROUP BY 1, 2)"""


def streaks(t: Tables):
    from corroborate.operators.novelty import low_novelty_streak

    cust = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("topic_id"), F.col("c_mktsegment").alias("segment"))
    weekly = t.orders.join(cust, "o_custkey").groupBy("topic_id", "segment", F.date_format("o_orderdate", "yyyy-MM").alias("week")).agg(
        (F.avg("o_totalprice") < 330000).alias("low_novelty")
    )
    return low_novelty_streak(weekly, ["topic_id", "segment"])


EXH_SQL = f"""{GAPS_SQL}, {_STREAK}, exh AS (SELECT c.pack, c.segment, CAST(sum(low_attempts) AS BIGINT) AS attempts, min(streak) AS weeks, max(streak_since) AS since FROM cells c JOIN topics USING (pack) LEFT JOIN streaks s ON s.topic_id = topics.topic_id AND s.segment = c.segment
  WHERE status <> 'green' AND EXISTS (SELECT 1 FROM judged j WHERE j.pack = c.pack AND j.segment = c.segment AND criterion_status <> 'green' AND fix_type = 'harvest' AND score IS NOT NULL)
  GROUP BY 1, 2 HAVING bool_and(coalesce(streak >= {K_WEEKS}, FALSE) AND streak_since IS NOT NULL))"""


def exhausted(t: Tables):
    return t.once("exhausted", _exhausted)


def _exhausted(t: Tables):
    j = judged(t)
    return M.exhaustion(M.cell_status(j), j, topics(t).select("pack", "topic_id"), streaks(t), K_WEEKS)


@query("exhaustion", f"WITH {EXH_SQL} SELECT * FROM exh")
def exhaustion(t: Tables):
    return exhausted(t)


ROUTE_SQL = f"""{EXH_SQL}, kinds AS (SELECT pack, segment, bool_or(fix_type = 'harvest' AND criterion <> 'segment_evidence') AS h, bool_or(fix_type = 'pipeline') AS p FROM tg GROUP BY 1, 2),
routed AS (SELECT c.pack, c.segment, status, CASE WHEN status = 'green' THEN 'green' WHEN e.weeks IS NOT NULL THEN 'exhausted' WHEN h THEN 'harvest' WHEN p THEN 'pipeline' ELSE 'authoring' END AS route
  FROM cells c LEFT JOIN kinds USING (pack, segment) LEFT JOIN exh e USING (pack, segment))"""


def routed(t: Tables):
    return M.cell_route(M.cell_status(judged(t)), gaps(t), exhausted(t))


@query("cell_route", f"WITH {ROUTE_SQL} SELECT * FROM routed")
def cell_route(t: Tables):
    return routed(t)


_BAND = "CASE WHEN route = 'harvest' THEN status ELSE route END"


@query(
    "coverage_counts",
    f"""WITH {ROUTE_SQL}, b AS (SELECT pack, segment, {_BAND} AS band FROM routed)
    SELECT CASE WHEN pack IS NOT NULL THEN 'pack' WHEN segment IS NOT NULL THEN 'segment' ELSE 'overall' END AS scope, coalesce(CAST(pack AS VARCHAR), segment, 'all') AS key,
    {', '.join(f"count_if(band = '{b}') AS {b}" for b in M.BANDS)}, count(*) AS total, CAST(floor(100 * count_if(band = 'green') / count(*) + 0.5) AS BIGINT) AS pct_green FROM b GROUP BY GROUPING SETS ((), (pack), (segment))""",
)
def coverage_counts(t: Tables):
    return M.coverage_counts(routed(t).withColumn("pack", F.col("pack").cast("string")))


@query(
    "heatmap",
    f"""WITH {CELLS_SQL} SELECT pack, {', '.join(f"max(CASE WHEN segment = '{s}' THEN status END) AS {s}" for s in [*SEGMENTS, 'MACHINERY'])} FROM cells GROUP BY pack""",
)
def heatmap(t: Tables):
    return M.heatmap(M.cell_status(judged(t)), [*SEGMENTS, "MACHINERY"])


@query(
    "cell_novelty",
    f"WITH {TOPICS_SQL}, {_STREAK} SELECT pack, segment, count(*) AS streaking, (SELECT count(*) FROM topics x WHERE x.pack = topics.pack) AS members FROM topics JOIN streaks USING (topic_id) WHERE streak >= 1 GROUP BY 1, 2",
)
def cell_novelty(t: Tables):
    return M.cell_novelty(topics(t).select("pack", "topic_id"), streaks(t))


@query(
    "cross_cutting_row",
    f"""WITH c AS (SELECT c_mktsegment AS segment, count(*) AS members, {R4.format('count_if(c_acctbal > 0) / count(*)')} AS score FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 4 GROUP BY 1)
    SELECT 'perception' AS pack, segment, members, score, CASE WHEN score >= 0.5 THEN 'green' WHEN score >= 0.3 THEN 'amber' ELSE 'red' END AS status FROM c""",
)
def cross_cutting_row(t: Tables):
    crossing = t.nation.filter("n_regionkey = 4").select(F.col("n_nationkey").alias("c_nationkey"))
    row = t.customer.join(crossing, "c_nationkey").groupBy(F.lit("perception").alias("pack"), F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("members"), S.round4(F.count_if(F.col("c_acctbal") > 0) / F.count(F.lit(1))).alias("score")
    )
    return row.withColumn("status", S.status_for(F.col("score"), F.lit(0.5), F.lit(0.3)))


@query(
    "dossier_gate",
    """WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey % 4 END AS evidence, o_custkey % 4 AS safety, o_orderkey % 3 AS reach, o_custkey % 5 AS fit, o_orderkey % 5 AS cost FROM orders)
    SELECT o_orderkey, CASE WHEN evidence IS NOT NULL THEN evidence + safety + reach + fit + cost END AS total,
    CASE WHEN evidence IS NULL THEN 'unscored' WHEN evidence + safety + reach + fit + cost >= 11 AND evidence >= 2 AND safety >= 2 THEN 'incubating' ELSE 'rejected' END AS verdict FROM d""",
)
def dossier_gate(t: Tables):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d = t.orders.select(
        k, F.when(k % 17 != 0, k % 4).alias("evidence"), (c % 4).alias("safety"), (k % 3).alias("reach"), (c % 5).alias("fit"), (k % 5).alias("cost")
    )
    return M.dossier_gate(d, ["evidence", "safety", "reach", "fit", "cost"]).select("o_orderkey", "total", "verdict")


# --- planning ----------------------------------------------------------------------------
SEGMENT_WEIGHTS = {"AUTOMOBILE": 1.5, "BUILDING": 0.8}
_WSQL = "sw AS (SELECT segment, CAST(CASE segment WHEN 'AUTOMOBILE' THEN 1.5 WHEN 'BUILDING' THEN 0.8 ELSE 1 END AS DOUBLE) AS weight FROM seg)"


def segment_weights(t: Tables):
    names = t.customer.select(F.col("c_mktsegment").alias("segment")).distinct()
    return names.select("segment", M.lookup(SEGMENT_WEIGHTS, F.col("segment"), 1.0).alias("segment_weight"))


GAP_SQL = f"""{EXH_SQL}, {_WSQL}, gs AS (SELECT pack, segment, fix_type, sum(greatest(0, green - coalesce(score, 0))) AS gap FROM judged WHERE criterion_status <> 'green' GROUP BY 1, 2, 3),
hv AS (SELECT pack, segment, {R4.format('weight * gap')} AS importance, weight FROM gs JOIN sw USING (segment) WHERE fix_type = 'harvest')"""


@query("gap_size", f"WITH {GAP_SQL} SELECT pack, segment, importance FROM hv")
def gap_size(t: Tables):
    return N.cell_importance(judged(t), segment_weights(t), ["harvest"]).select("pack", "segment", "importance")


_HQ = f"""{GAP_SQL}, {_CAND.replace('cand AS', 'cand0 AS')}, seedm AS (SELECT n_nationkey AS topic_id FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 2500)),
ex AS (SELECT c.pack, c.segment, c.status, importance, weight, segment_evidence = 'general_only' AS general_only FROM cells c JOIN hv USING (pack, segment) JOIN ev USING (pack, segment)
  WHERE status <> 'green' AND (c.pack, c.segment) NOT IN (SELECT (pack, segment) FROM exh)),
cd AS (SELECT topic_id, segment, ex.pack, status, general_only, {R4.format('importance + CASE WHEN topic_id IN (SELECT topic_id FROM seedm) THEN weight ELSE 0 END')} AS importance,
  CASE WHEN topic_id IN (SELECT topic_id FROM seedm) THEN 200 ELSE list_position({_GR}, grade) - 1 END + CASE WHEN flagged THEN 100 ELSE 0 END AS weakness FROM ex JOIN topics USING (pack)),
rk AS (SELECT *, CASE status WHEN 'red' THEN 0 ELSE 1 END AS s FROM cd)"""


def candidates(t: Tables):
    return t.once("candidates", _candidates)


def _candidates(t: Tables):
    j = judged(t)
    cells = M.cell_status(j).join(M.segment_evidence(weights(t)), ["pack", "segment"])
    sized = N.cell_importance(j, segment_weights(t), ["harvest"])
    open_cells = (
        cells.filter("status <> 'green'").join(sized, ["pack", "segment"]).join(exhausted(t).select("pack", "segment"), ["pack", "segment"], "left_anti")
        .withColumn("general_only", F.col("segment_evidence") == "general_only")
        .select("pack", "segment", "status", "importance", "segment_weight", "general_only")
    )
    seeds = _seed_members(t).select(F.col("key").alias("topic_id"), F.lit(True).alias("is_seed"))
    full = topics(t)
    graded = full.select("topic_id", "grade", "flagged").join(seeds, "topic_id", "left").withColumn("is_candidate", F.coalesce("is_seed", F.lit(False)))
    return N.harvest_candidates(open_cells, full.select("pack", "topic_id"), graded)


@query("dedupe_work_items", f"WITH {_HQ} SELECT topic_id, segment, pack, importance, CAST(weakness AS BIGINT) AS weakness FROM cd")
def dedupe_work_items(t: Tables):
    return candidates(t).select("topic_id", "segment", "pack", "importance", "weakness")


@query(
    "harvest_queue",
    f"""WITH {_HQ} SELECT topic_id, segment, pack, status, importance, CAST(weakness AS BIGINT) AS weakness,
      CAST(row_number() OVER (ORDER BY importance DESC, s, general_only DESC, weakness DESC, pack, topic_id, segment) AS INTEGER) AS rank
    FROM rk WHERE topic_id % 5 <> 2 QUALIFY rank <= 20""",
)
def harvest_queue(t: Tables):
    c = candidates(t)
    repeats = c.filter(F.col("topic_id") % 5 == 2)
    queue, _ = N.harvest_queue(c, repeats, 20)
    return queue.select("topic_id", "segment", "pack", "status", "importance", "weakness", "rank")


@query(
    "low_novelty_skipped",
    f"""WITH {_HQ}, o AS (SELECT *, row_number() OVER (ORDER BY importance DESC, s, general_only DESC, weakness DESC, pack, topic_id, segment) AS rn FROM rk),
    f AS (SELECT rn FROM o WHERE topic_id % 5 <> 2 ORDER BY rn LIMIT 1 OFFSET 19) SELECT count(*) AS low_novelty_skipped FROM o WHERE topic_id % 5 = 2 AND rn < coalesce((SELECT rn FROM f), 1000000)""",
)
def low_novelty_skipped(t: Tables):
    c = candidates(t)
    return N.harvest_queue(c, c.filter(F.col("topic_id") % 5 == 2), 20)[1]


@query(
    "extraction_queue",
    f"""WITH {GAP_SQL}, m AS (SELECT pack, segment, criterion, score, green, unnest(list_filter([CASE WHEN criterion IN ('effect_coverage', 'extraction_completeness') THEN 'effects' END,
      CASE WHEN criterion IN ('realization_density', 'extraction_completeness') THEN 'realizations' END, CASE WHEN criterion = 'dissent_completeness' THEN 'dissent' END], lambda x: x IS NOT NULL)) AS mode
      FROM judged WHERE criterion_status <> 'green' AND fix_type = 'pipeline'),
    z AS (SELECT pack, segment, mode, sum(greatest(0, green - coalesce(score, 0))) AS gap, list(criterion) AS crit FROM m GROUP BY 1, 2, 3),
    q AS (SELECT topic_id, mode, max({R4.format('weight * gap')}) AS importance, count(*) AS source_cells, array_to_string(list_sort(list_distinct(flatten(list(crit)))), ',') AS criteria FROM z JOIN sw USING (segment) JOIN topics USING (pack)
      WHERE CASE WHEN mode = 'realizations' THEN realizations > 0 ELSE records > 0 END GROUP BY 1, 2)
    SELECT * FROM q ORDER BY importance DESC, topic_id, mode LIMIT 15""",
)
def extraction_queue(t: Tables):
    full = topics(t)
    has = full.select("topic_id", (F.col("records") > 0).alias("has_evidence"), (F.col("realizations") > 0).alias("has_realizations"))
    queue = N.extraction_queue(judged(t), full.select("pack", "topic_id"), has, segment_weights(t), 15)
    return queue.withColumn("criteria", F.array_join("criteria", ","))


@query(
    "authoring_queue",
    f"""WITH {GAP_SQL}, st AS (SELECT pack, segment, sum(greatest(0, green - coalesce(score, 0))) AS g, count(*) AS n FROM judged WHERE criterion_status <> 'green' AND fix_type = 'structural' GROUP BY 1, 2),
    ha AS (SELECT pack, segment, gap FROM gs WHERE fix_type = 'harvest')
    SELECT c.pack, c.segment, status, {R4.format('weight * coalesce(g, gap, 0)')} AS importance, coalesce(n, 0) AS structural_gaps, e.weeks IS NOT NULL AS alternative_fill
    FROM cells c JOIN sw USING (segment) LEFT JOIN st USING (pack, segment) LEFT JOIN ha USING (pack, segment) LEFT JOIN exh e USING (pack, segment) WHERE status <> 'green' AND (n IS NOT NULL OR e.weeks IS NOT NULL)""",
)
def authoring_queue(t: Tables):
    j = judged(t)
    return N.authoring_queue(M.cell_status(j), j, exhausted(t), segment_weights(t))


@query(
    "suggested_terms",
    """SELECT o_custkey, array_to_string(list_transform(list_slice(list_sort(list(DISTINCT o_orderpriority)), 1, 3), lambda x: trim(x || ' for b2b')), ';') AS terms FROM orders GROUP BY 1""",
)
def suggested_terms(t: Tables):
    base = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("terms"))
    terms = N.suggested_terms(F.col("terms"), F.lit("name"), F.lit("for b2b"))
    return base.select("o_custkey", F.array_join(terms, ";").alias("terms"))


@query(
    "repeat_harvests",
    """WITH t AS (SELECT o_custkey, list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'F') AS a, list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus <> 'F') AS b, avg(o_totalprice) < 260000 AS low FROM orders GROUP BY 1)
    SELECT o_custkey FROM t WHERE list_sort(a) = list_sort(b) AND low""",
)
def repeat_harvests(t: Tables):
    done = F.col("o_orderstatus") == "F"
    base = t.orders.groupBy("o_custkey").agg(
        F.collect_set(F.when(done, F.col("o_orderpriority"))).alias("a"),
        F.collect_set(F.when(~done, F.col("o_orderpriority"))).alias("b"),
        (F.avg("o_totalprice") < 260000).alias("low"),
    )
    return N.repeat_harvests(base, "a", "b", "low").select("o_custkey")


_USE = "u AS (SELECT sum(CAST(value AS DECIMAL(18, 2))) AS usd, sum(user_id % 20) AS calls FROM events WHERE event_type = 'purchase')"


@query(
    "budget_snapshot",
    f"WITH {_USE} SELECT CAST(usd AS DOUBLE) AS usd_used, CAST(calls AS BIGINT) AS calls_used, greatest(0, CAST(90000 - usd AS DOUBLE)) AS usd_left, CAST(greatest(0, 20000 - calls) AS BIGINT) AS calls_left, CAST(greatest(0, least(25, floor(greatest(0, 20000 - calls) * 0.25 / 20))) AS BIGINT) AS max_tasks FROM {'u'}",
)
def budget_snapshot(t: Tables):
    use = t.events.filter("event_type = 'purchase'").select(F.col("value").cast("decimal(18,2)").alias("usd"), (F.col("user_id") % 20).alias("calls"))
    exact = use.agg(F.sum("usd").cast("double").alias("usd"), F.sum("calls").alias("calls"))
    snap = N.budget_snapshot(exact, 90000.0, 20000)
    return snap.withColumn("max_tasks", N.budget_max_tasks(F.col("calls_left"), 0.25, 20, 25))


@query(
    "budget_state",
    """WITH s AS (SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS usd, sum(event_id % 1000) AS tokens FROM events GROUP BY 1)
    SELECT user_id, CASE WHEN usd >= 1800 OR tokens >= 40000 THEN 'paused' WHEN usd / 1800 * 100 >= 80 OR tokens / 40000 * 100 >= 80 THEN 'warning' ELSE 'normal' END AS level FROM s""",
)
def budget_state(t: Tables):
    s = t.events.groupBy("user_id").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("usd"), F.sum(F.col("event_id") % 1000).alias("tokens"))
    return s.select("user_id", N.budget_state(F.col("usd"), F.lit(1800.0), F.col("tokens"), F.lit(40000)).alias("level"))


@query(
    "admit",
    """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_custkey % 200 > 150 THEN 'max_calls_per_run' END, CASE WHEN o_orderkey % 1300 > 1000 THEN 'max_records_per_run' END,
    CASE WHEN 19900 + o_custkey % 200 > 20000 OR 20 + o_totalprice / 5000 > 100 THEN 'monthly_budget' END], lambda r: r IS NOT NULL), ',') AS reasons FROM orders""",
)
def admit(t: Tables):
    reasons = N.admit(
        F.col("o_custkey") % 200, F.col("o_orderkey") % 1300, F.col("o_totalprice") / 5000, F.lit(19900), F.lit(20), 150, 1000, 20000, 100.0
    )
    return t.orders.select("o_orderkey", F.array_join(reasons, ",").alias("reasons"))


@query(
    "greedy_admission",
    """WITH RECURSIVE q AS (SELECT o_custkey AS k, o_orderkey, o_totalprice AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
    g AS (SELECT k, o_orderkey, rn, CASE WHEN c > 900000 THEN 'defer' WHEN c > 480000 THEN 'skip' ELSE 'run' END AS action, 900000 - CASE WHEN c <= 480000 THEN c ELSE 0 END AS budget FROM q WHERE rn = 1
      UNION ALL SELECT q.k, q.o_orderkey, q.rn, CASE WHEN c > budget THEN 'defer' WHEN c > 480000 THEN 'skip' ELSE 'run' END, budget - CASE WHEN c <= budget AND c <= 480000 THEN c ELSE 0 END FROM g JOIN q ON q.k = g.k AND q.rn = g.rn + 1)
    SELECT k AS o_custkey, o_orderkey, action FROM g""",
)
def greedy_admission(t: Tables):
    queue = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("rank"), F.col("o_totalprice").alias("cost"), F.lit(900000.0).alias("cap"))
    return N.greedy_admission(queue, "o_custkey", "o_orderkey", "rank", "cost", "cap", 480000)


_QUEUE_SQL = """q AS (
  SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 50 + 1 END AS k, o_orderkey, o_custkey % 90 AS calls, o_orderkey % 1200 AS records, CAST(o_totalprice / 1000 AS DECIMAL(28, 9)) AS usd,
    o_orderkey % 101 = 0 AS paused, o_custkey % 67 = 0 AS down FROM orders),
b AS (SELECT k, greatest(1500, count(*) * 20) AS call_cap, CAST(greatest(4000, count(*) * 70) AS DECIMAL(28, 9)) AS usd_cap FROM q GROUP BY 1),
w AS (SELECT q.*, call_cap, usd_cap, row_number() OVER (PARTITION BY k ORDER BY usd DESC, o_orderkey) AS rn,
    CASE WHEN calls > 85 THEN 'max_calls_per_run' WHEN records > 1100 THEN 'max_records_per_run' END AS over FROM q JOIN b USING (k) WHERE NOT paused AND NOT down),
g AS (
  SELECT k, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS o_orderkey, '' AS action, CAST(call_cap AS BIGINT) AS lc, usd_cap AS lu FROM b
  UNION ALL
  SELECT w.k, w.rn, w.o_orderkey, CASE WHEN calls > lc OR usd > lu THEN 'defer' WHEN over IS NOT NULL THEN 'skip' ELSE 'run' END,
    CAST(lc - CASE WHEN over IS NULL AND calls <= lc AND usd <= lu THEN calls ELSE 0 END AS BIGINT), CAST(lu - CASE WHEN over IS NULL AND calls <= lc AND usd <= lu THEN usd ELSE 0 END AS DECIMAL(28, 9))
  FROM g JOIN w ON w.k = g.k AND w.rn = g.rn + 1)
SELECT g.k, g.o_orderkey, action, CASE action WHEN 'defer' THEN 'monthly_budget' WHEN 'skip' THEN over END AS reason FROM g JOIN w USING (k, rn)
UNION ALL SELECT k, o_orderkey, 'skip', CASE WHEN paused THEN 'paused' ELSE 'source_down' END FROM q WHERE paused OR down"""


@query("queue_admission", f"WITH RECURSIVE {_QUEUE_SQL}")
def queue_admission(t: Tables):
    key = F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_custkey") % 50 + 1)
    usd = (F.col("o_totalprice") / 1000).cast("decimal(28,9)")
    tasks = t.orders.select(
        key.alias("k"), "o_orderkey", (-usd).alias("rank"), (F.col("o_custkey") % 90).alias("calls"), (F.col("o_orderkey") % 1200).alias("records"), usd.alias("usd"),
        (F.col("o_orderkey") % 101 == 0).alias("paused"), (F.col("o_custkey") % 67 == 0).alias("down"),
    )
    caps = tasks.groupBy("k").agg(F.greatest(F.lit(1500), F.count(F.lit(1)) * 20).alias("call_cap"), F.greatest(F.lit(4000), F.count(F.lit(1)) * 70).alias("usd_cap"))
    return N.admit_queue(tasks.join(caps, "k"), "k", "o_orderkey", "rank", max_calls=85, max_records=1100)


@query(
    "due_targets",
    """WITH x AS (SELECT o_orderkey, o_orderkey % 11 = 0 AS paused, (epoch(TIMESTAMP '1998-06-01') - epoch(o_orderdate)) / 86400 AS since, o_custkey % 3 = 0 AS down, (o_custkey % 24) AS age, (epoch(TIMESTAMP '1998-06-01') - epoch(o_orderdate)) / 86400 / 30 AS changed FROM orders)
    SELECT o_orderkey, CASE WHEN paused THEN 'paused' WHEN since < 60 THEN 'not_due' WHEN down AND age < 12 THEN 'source_down' WHEN changed > 7 THEN 'unchanged' END AS reason FROM x""",
)
def due_targets(t: Tables):
    now = F.to_timestamp(F.lit("1998-06-01"))
    at = F.col("o_orderdate").cast("timestamp")
    rows = t.orders.select(
        "o_orderkey",
        (F.col("o_orderkey") % 11 == 0).alias("paused"),
        at.alias("last_run"),
        F.lit(60).alias("every_days"),
        F.when(F.col("o_custkey") % 3 == 0, "down").otherwise("up").alias("source_status"),
        F.timestamp_seconds(S.seconds(now) - (F.col("o_custkey") % 24) * 3600).alias("checked_at"),
        F.timestamp_seconds((S.seconds(now) - (S.seconds(now) - S.seconds(at)) / 30)).alias("changed_at"),
    )
    return N.due_targets(rows, now).select("o_orderkey", "reason")


def plan_sql(anchored: bool) -> str:
    by = "affinity, tier" if anchored else "tier, coalesce(citations, -1) DESC"
    return f"""{RECORDS_SQL.strip()}, h AS (SELECT *, {HITS_SQL} FROM records), el AS (SELECT topic_id, record_id, citations, {TIER_SQL} AS tier, {AFFINITY_SQL} AS affinity,
  CAST(ceil(strlen(title || chr(10) || coalesce(abstract, '')) / 4.0) AS BIGINT) AS tokens FROM h), te AS (SELECT doc_id AS record_id FROM labels WHERE quality = 1),
pn AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY {by}, record_id) AS rn FROM el WHERE tier IS NOT NULL AND record_id NOT IN (SELECT record_id FROM te)),
pl AS (SELECT topic_id, record_id, rn, (rn - 1) // 25 AS batch_no, sum(tokens + CASE WHEN (rn - 1) % 25 = 0 THEN 300 ELSE 0 END + CASE WHEN rn = 1 THEN 500 ELSE 0 END) OVER (ORDER BY topic_id, rn) <= 90000 AS selected FROM pn)"""


_PLAN = plan_sql(anchored=False)


def reading_inputs(t: Tables):
    tokens = X.estimate_tokens(X.source_text(F.col("title"), F.col("abstract")))
    eligible = tiered(t).select("topic_id", "record_id", "tier", "affinity", "citations", tokens.alias("tokens"))
    done = t.labels.filter("quality = 1").select(F.col("doc_id").alias("record_id"))
    terminal = eligible.select("topic_id", "record_id").join(done, "record_id", "left_semi")
    return eligible, terminal


@query("reading_plan", f"WITH {_PLAN} SELECT topic_id, record_id, rn, batch_no, selected FROM pl")
def reading_plan(t: Tables):
    eligible, terminal = reading_inputs(t)
    plan = N.reading_plan(eligible, terminal, 90000, 25, 300, 500)
    return plan.select("topic_id", "record_id", "rn", "batch_no", "selected")


@query("anchored_plan", f"WITH {plan_sql(anchored=True)} SELECT topic_id, record_id, rn, batch_no, selected FROM pl")
def anchored_plan(t: Tables):
    eligible, terminal = reading_inputs(t)
    plan = N.reading_plan(eligible, terminal, 90000, 25, 300, 500, anchored=True)
    return plan.select("topic_id", "record_id", "rn", "batch_no", "selected")


@query(
    "plan_counts",
    f"""WITH {_PLAN} SELECT topic_id, count(*) AS eligible, count_if(d) AS done, count_if(tier IS NULL AND NOT d) AS skipped, (SELECT count(*) FILTER (WHERE selected) FROM pl WHERE pl.topic_id = x.topic_id) AS selected, (SELECT count(*) FILTER (WHERE NOT selected) FROM pl WHERE pl.topic_id = x.topic_id) AS remaining
    FROM (SELECT *, record_id IN (SELECT record_id FROM te) AS d FROM el) x GROUP BY 1""",
)
def plan_counts(t: Tables):
    eligible, terminal = reading_inputs(t)
    return N.plan_counts(eligible, terminal, N.reading_plan(eligible, terminal, 90000, 25, 300, 500))


@query(
    "cost_quote",
    f"""WITH {_PLAN}, q AS (SELECT topic_id, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(count(DISTINCT batch_no) + 1 AS BIGINT) AS calls FROM pl JOIN el USING (topic_id, record_id) WHERE selected GROUP BY 1)
    SELECT topic_id, tokens, calls, floor((tokens * CAST(0.0000025 AS DOUBLE) + calls * 800 * CAST(0.00001 AS DOUBLE)) * 100000000 + 0.5) / 100000000 AS usd, tokens > 50000 AS over_cap FROM q""",
)
def cost_quote(t: Tables):
    eligible, terminal = reading_inputs(t)
    plan = N.reading_plan(eligible, terminal, 90000, 25, 300, 500).filter("selected")
    q = plan.groupBy("topic_id").agg(F.sum("tokens").alias("tokens"), (F.countDistinct("batch_no") + 1).alias("calls"))
    usd = N.cost_quote(F.col("tokens"), F.col("calls"), 0.0000025, 0.00001, 800)
    return q.select("topic_id", "tokens", "calls", usd.alias("usd"), (F.col("tokens") > 50000).alias("over_cap"))
