"""Ledger, constraints, replay and consumer projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from corroborate.functions import scalars as S
from corroborate.functions import text as X
from corroborate.functions import vocabulary as V
from corroborate.operators import constraints as P
from corroborate.operators import folding as D
from corroborate.operators import grounding as G
from corroborate.operators import ledger as O
from corroborate.operators import reports as Q
from corroborate.plans.analytics import DETAIL_SQL, _detail, _snapshots, trade_edges
from corroborate.plans.entity import full_record, status_of
from corroborate.plans.evidence import CITATION_SQL, citations, gate_inputs, sources, _GATE_SQL
from corroborate.plans.registry import Tables, query
from corroborate.plans.views import RECORDS_SQL, norm_sql, records
from corroborate.sources import sinks

# --- ledger --------------------------------------------------------------------------------
_STAGE = "CASE WHEN fate IN ('into_synthesis', 'synthesis_batch_failed') THEN 'cheap' WHEN fate = 'dropped_ungrounded' THEN pass ELSE 'strong' END"
_COUNTS = ", ".join(
    [f"count_if(stage = 'cheap' AND fate = '{f}') AS cheap_{f}" for f in O.CHEAP_FATES]
    + [f"count_if(stage = 'strong' AND fate = '{f}') AS strong_{f}" for f in O.STRONG_FATES]
)
LEDGER_SQL = f"""{DETAIL_SQL}, sd AS (SELECT *, {_STAGE} AS stage FROM detail),
pt AS (SELECT run_id, topic_id, count_if(fate = 'into_synthesis') AS i, count_if(stage = 'strong') AS s FROM sd GROUP BY 1, 2),
net AS (SELECT run_id, sum(i - s) AS net FROM pt GROUP BY 1),
ledger AS (SELECT sd.run_id, count(*) AS candidates, count_if(stage = 'cheap') AS cheap_candidates, count_if(stage = 'strong') AS strong_candidates, count_if(fate = 'into_synthesis') AS into_synthesis, {_COUNTS},
  CAST(greatest(any_value(net), 0) AS BIGINT) AS consolidated, CAST(greatest(-any_value(net), 0) AS BIGINT) AS expanded FROM sd JOIN net USING (run_id) GROUP BY 1)"""


@query("ledger_build", f"WITH {LEDGER_SQL} SELECT * FROM ledger")
def ledger_build(t: Tables):
    return O.ledger_build(_detail(t))


def _tampered(t: Tables):
    """The ledger with one counter of some runs off, the way a lost row would leave it."""
    n = F.regexp_extract("run_id", "([0-9]+)$", 1).cast("int")
    runs = O.ledger_build(_detail(t)).withColumn("status", F.when(n % 5 == 4, "partial").otherwise("recorded"))
    return (
        runs.withColumn("candidates", F.col("candidates") + F.when(n % 4 == 1, 1).otherwise(0))
        .withColumn("strong_proposed", F.col("strong_proposed") - F.when(n % 4 == 2, 1).otherwise(0))
        .withColumn("consolidated", F.col("consolidated") + F.when(n % 4 == 3, 2).otherwise(0))
        .withColumn("cheap_candidates", F.when(n == 8, F.lit(None)).otherwise(F.col("cheap_candidates")))
    )


@query(
    "ledger_balance",
    f"""WITH {LEDGER_SQL}, n AS (SELECT *, CAST(regexp_extract(run_id, '([0-9]+)$', 1) AS INTEGER) AS n FROM ledger)
    SELECT run_id, 'total' AS violation FROM n WHERE n % 4 = 1 UNION ALL SELECT run_id, 'strong_stage' FROM n WHERE n % 4 = 2
    UNION ALL SELECT run_id, 'synthesis_stage' FROM n WHERE n % 4 = 3 UNION ALL SELECT run_id, 'fold_both_ways' FROM n WHERE n % 4 = 3 AND expanded > 0
    UNION ALL SELECT run_id, 'unknown_stage' FROM n WHERE n = 8 AND n % 5 <> 4 UNION ALL SELECT run_id, 'negative_counter' FROM n WHERE n % 4 = 2 AND strong_proposed = 0""",
)
def ledger_balance(t: Tables):
    return O.ledger_balance(_tampered(t))


@query(
    "ledger_entries",
    f"""WITH {DETAIL_SQL} SELECT run_id, candidate_id, 'reason_missing' AS violation FROM detail WHERE fate = 'dropped_ungrounded' AND reason IS NULL
    UNION ALL SELECT run_id, candidate_id, 'attribution_missing' FROM detail WHERE fate IN ('merged_into_pending', 'proposed_enrich') AND attribution IS NULL
    UNION ALL SELECT run_id, candidate_id, 'unreachable_fate' FROM detail WHERE conv_id % 9 = 0 AND fate IN ('proposed', 'merged_into_pending', 'held_low_confidence', 'proposed_enrich', 'failed_validation', 'dropped_volume_cap')
    UNION ALL SELECT run_id, candidate_id, 'unreachable_fate' FROM detail WHERE conv_id % 9 = 0 AND fate IN ('into_synthesis', 'synthesis_batch_failed')""",
)
def ledger_entries(t: Tables):
    d = _detail(t)
    conv = F.split("candidate_id", ":")[0].cast("int")
    flipped = F.when(F.col("pass") == "cheap", "strong").otherwise("cheap")
    return O.entry_violations(d.withColumn("pass", F.when(conv % 9 == 0, flipped).otherwise(F.col("pass"))))


@query(
    "ledger_detail",
    f"""WITH {LEDGER_SQL}, n AS (SELECT run_id, CAST(regexp_extract(run_id, '([0-9]+)$', 1) AS INTEGER) AS n FROM ledger) SELECT run_id, 'strong_detail' AS violation FROM n WHERE n % 3 = 0 AND n % 5 <> 4""",
)
def ledger_detail(t: Tables):
    n = F.regexp_extract("run_id", "([0-9]+)$", 1).cast("int")
    runs = O.ledger_build(_detail(t)).withColumn("status", F.when(n % 5 == 4, "partial").otherwise("recorded"))
    runs = runs.withColumn("strong_candidates", F.col("strong_candidates") + F.when(n % 3 == 0, 1).otherwise(0))
    return O.ledger_detail(runs, _detail(t))


_CAND_SQL = """c AS (SELECT o_orderkey AS candidate_id, o_custkey % 40 AS topic_id, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS identity, o_totalprice / 500000 AS confidence, o_orderkey % 7 = 0 AS refused, o_orderkey % 5 <> 0 AS transferable,
  o_orderkey % 6 = 1 AS pending, o_orderkey % 6 = 2 AS approved, o_orderkey % 4 <> 0 AS adds FROM orders),
s AS (SELECT *, CASE WHEN refused THEN 'dropped_ungrounded' WHEN NOT transferable THEN 'held_non_transferable' WHEN pending THEN 'merged_into_pending' WHEN confidence < 0.5 OR (approved AND NOT adds) THEN 'held_low_confidence' WHEN approved THEN 'proposed_enrich' ELSE 'proposed' END AS fate FROM c)"""


@query(
    "candidate_fate",
    f"""WITH {_CAND_SQL} SELECT candidate_id, CASE WHEN starts_with(fate, 'proposed') AND row_number() OVER (PARTITION BY topic_id, starts_with(fate, 'proposed') ORDER BY confidence DESC, identity) > 30 THEN 'dropped_volume_cap' ELSE fate END AS fate FROM s""",
)
def candidate_fate(t: Tables):
    return O.candidate_fate(_candidates(t), 30).select("candidate_id", "fate")


def _candidates(t: Tables):
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("candidate_id"),
        (F.col("o_custkey") % 40).alias("topic_id"),
        F.lpad(k.cast("string"), 12, "0").alias("identity"),
        (F.col("o_totalprice") / 500000).alias("confidence"),
        F.when(k % 7 == 0, "quote_not_in_source").alias("gate_reason"),
        (k % 5 != 0).alias("transferable"),
        F.when((k % 6).isin(1, 2), k).alias("match_id"),
        F.when(k % 6 == 1, "pending").when(k % 6 == 2, "approved").alias("match_status"),
        (k % 4 != 0).alias("adds_value"),
    )


@query(
    "fold_batch",
    f"""WITH k AS (SELECT doc_id, lang, list_sort(list_distinct(list_filter(string_split({norm_sql('text')}, ' '), lambda w: length(w) > 1))) AS tokens FROM documents)
    SELECT doc_id AS candidate_id, first_value(doc_id) OVER (PARTITION BY lang, tokens ORDER BY doc_id) AS stands FROM k""",
)
def fold_batch(t: Tables):
    rows = t.documents.select(
        F.col("doc_id").alias("candidate_id"), F.col("lang").alias("block"), X.quality_tokens(F.col("text")).alias("tokens"), F.col("doc_id").alias("seq")
    )
    return O.fold_batch(rows)


_CLAIMS_SQL = f"""d AS (
  SELECT doc_id AS id, doc_id * 7919 % 100003 AS seq, ['effect', 'realization', 'interaction', 'dossier_section', 'edge'][doc_id % 10 // 2 + 1] AS kind, coalesce(lang, '') AS target,
    {norm_sql('text')} AS words, source || ':' || n_chars % 40 AS pair, CAST(doc_id % 3 AS VARCHAR) AS field, n_chars % 100 / 100 AS confidence,
    doc_id % 5 = 0 AS old, CASE WHEN doc_id % 10 = 0 THEN 'approved' ELSE 'pending' END AS status, doc_id % 7 = 0 AS refused, doc_id % 11 <> 0 AS transferable, doc_id % 4 <> 0 AS adds
  FROM documents),
sets AS (
  SELECT id, 'title' || kind || target AS block, list_distinct(list_filter(string_split(words, ' ')[:5], lambda w: length(w) > 1)) AS tokens FROM d WHERE kind IN ('effect', 'realization')
  UNION ALL SELECT id, 'body' || kind || target || CASE WHEN kind = 'dossier_section' THEN field ELSE '' END, list_distinct(list_filter(string_split(words, ' '), lambda w: length(w) > 1)) FROM d WHERE kind <> 'interaction'
  UNION ALL SELECT id, 'pair' || kind || target, [pair] FROM d WHERE kind = 'interaction'),
e AS (SELECT id, block, len(tokens) AS n, unnest(tokens) AS token FROM sets),
i AS (SELECT a.id AS a, b.id AS b, a.n AS an, b.n AS bn, count(*) AS k FROM e a JOIN e b ON a.block = b.block AND a.token = b.token AND a.id <> b.id GROUP BY a.id, b.id, a.block, a.n, b.n),
s AS (SELECT a, b, max(greatest(k / (an + bn - k), k / least(an, bn) * CAST(0.9 AS DOUBLE))) AS score FROM i GROUP BY 1, 2 HAVING score >= 0.78),
m AS (SELECT a AS id, b AS match_id, status, score FROM s JOIN d ON d.id = b AND d.old QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) = 1),
c AS (SELECT d.*, m.match_id, m.status AS match_status, m.score FROM d LEFT JOIN m USING (id) WHERE NOT old),
q AS (SELECT id, match_status IS NOT NULL AS free, row_number() OVER (ORDER BY seq, id) AS rn FROM c WHERE NOT refused AND transferable AND coalesce(match_status, 'approved') = 'approved'),
n AS (SELECT a AS id, list(b) AS near FROM s GROUP BY 1),
o AS (SELECT rn, id, free, coalesce(near, []) AS near FROM q LEFT JOIN n USING (id)),
g AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS admitted
  UNION ALL SELECT o.rn, CASE WHEN o.free OR NOT list_has_any(g.admitted, o.near) THEN list_append(g.admitted, o.id) ELSE g.admitted END FROM g JOIN o ON o.rn = g.rn + 1),
w AS (SELECT unnest(admitted) AS b FROM g WHERE rn = (SELECT max(rn) FROM g)),
f AS (
  SELECT q.id, s.b AS match_id, s.score FROM q JOIN s ON s.a = q.id JOIN w USING (b) JOIN q p ON p.id = s.b AND p.rn < q.rn
  WHERE q.id NOT IN (SELECT b FROM w) QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY s.score DESC, s.b) = 1),
x AS (
  SELECT c.id, target, confidence, coalesce(c.match_id, f.match_id) AS match_id, coalesce(c.score, f.score) AS score, CASE WHEN f.id IS NOT NULL THEN 'pending' ELSE match_status END AS match_status,
    refused, transferable, adds FROM c LEFT JOIN f USING (id)),
y AS (
  SELECT id, target, confidence, CASE WHEN NOT refused AND transferable THEN match_id END AS match_id, CASE WHEN NOT refused AND transferable THEN score END AS score,
    CASE WHEN refused THEN 'dropped_ungrounded' WHEN NOT transferable THEN 'held_non_transferable' WHEN match_status = 'pending' THEN 'merged_into_pending'
      WHEN confidence < 0.5 OR (match_status = 'approved' AND NOT adds) THEN 'held_low_confidence' WHEN match_status = 'approved' THEN 'proposed_enrich' ELSE 'proposed' END AS fate FROM x)
SELECT id AS candidate_id, match_id, floor(score * 10000 + 0.5) / 10000 AS score,
  CASE WHEN starts_with(fate, 'proposed') AND row_number() OVER (PARTITION BY target, starts_with(fate, 'proposed') ORDER BY confidence DESC, id) > 60 THEN 'dropped_volume_cap' ELSE fate END AS fate FROM y"""


@query("candidate_folding", f"WITH RECURSIVE {_CLAIMS_SQL}")
def candidate_folding(t: Tables):
    i, words = F.col("doc_id"), X.norm_quality(F.col("text"))
    kinds = F.array(*[F.lit(k) for k in ("effect", "realization", "interaction", "dossier_section", "edge")])
    rows = t.documents.select(
        i.alias("id"),
        (i * 7919 % 100003).alias("seq"),
        F.element_at(kinds, (F.floor(i % 10 / 2) + 1).cast("int")).alias("kind"),
        F.coalesce("lang", F.lit("")).alias("target"),
        F.array_join(F.slice(F.split(words, " "), 1, 5), " ").alias("title"),
        F.col("text").alias("body"),
        F.concat_ws(":", "source", (F.col("n_chars") % 40).cast("string")).alias("pair"),
        (i % 3).cast("string").alias("field"),
        (F.col("n_chars") % 100 / 100).alias("confidence"),
    )
    known = rows.filter("id % 5 = 0").withColumn("status", F.when(F.col("id") % 10 == 0, "approved").otherwise("pending"))
    refused, transferable = F.col("id") % 7 == 0, F.col("id") % 11 != 0
    batch = rows.filter("id % 5 <> 0").withColumn("eligible", ~refused & transferable)
    matched = D.match_candidates(batch, known).select(
        F.col("id").alias("candidate_id"),
        F.col("target").alias("topic_id"),
        F.lpad(F.col("id").cast("string"), 12, "0").alias("identity"),
        "confidence",
        F.when(refused, "quote_not_in_source").alias("gate_reason"),
        transferable.alias("transferable"),
        "match_id",
        "match_status",
        (F.col("id") % 4 != 0).alias("adds_value"),
        (F.floor(F.col("match_score") * 10000 + 0.5) / 10000).alias("score"),
    )
    return O.candidate_fate(matched, 60).select("candidate_id", "match_id", "score", "fate")


@query(
    "batch_report",
    f"WITH {LEDGER_SQL} SELECT coalesce(run_id, 'total') AS run_id, CAST(sum(candidates) AS BIGINT) AS candidates, CAST(sum(strong_candidates) AS BIGINT) AS strong_candidates, CAST(sum(into_synthesis) AS BIGINT) AS into_synthesis FROM ledger WHERE starts_with(run_id, 'run1') GROUP BY ROLLUP (run_id)",
)
def batch_report(t: Tables):
    runs = O.ledger_build(_detail(t)).select("run_id", "candidates", "strong_candidates", "into_synthesis")
    return O.batch_report(runs, "run1")


@query(
    "batch_conservation",
    f"""WITH {LEDGER_SQL} SELECT CAST(sum(candidates) AS BIGINT) AS candidates, sum(candidates) = sum(cheap_candidates + strong_candidates) AS total_ok,
    sum(into_synthesis + expanded) = sum(consolidated + strong_candidates) AS synthesis_ok FROM ledger""",
)
def batch_conservation(t: Tables):
    runs = O.ledger_build(_detail(t))
    return runs.agg(
        F.sum("candidates").alias("candidates"),
        (F.sum("candidates") == F.sum(F.col("cheap_candidates") + F.col("strong_candidates"))).alias("total_ok"),
        (F.sum(F.col("into_synthesis") + F.col("expanded")) == F.sum(F.col("consolidated") + F.col("strong_candidates"))).alias("synthesis_ok"),
    )


@query(
    "run_status",
    "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'broken' WHEN value < 10 AND event_type = 'error' THEN 'failed' WHEN event_type = 'error' THEN 'partial' ELSE 'success' END AS status FROM events",
)
def run_status(t: Tables):
    status = O.run_status(
        F.col("event_id") % 9 != 0, F.lit(1), F.when(F.col("event_type") == "error", 1).otherwise(0), F.when(F.col("value") < 10, 0).otherwise(5)
    )
    return t.events.select("event_id", status.alias("status"))


# --- constraints -----------------------------------------------------------------------------
@query(
    "rule_violations",
    """WITH r AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id, unnest([CASE WHEN l_quantity NOT BETWEEN 2 AND 48 THEN 'quantity' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'returnflag' END, CASE WHEN l_discount > 0.09 THEN 'discount' END]) AS violation FROM lineitem)
    SELECT violation, count(*) AS rows FROM r WHERE violation IS NOT NULL GROUP BY 1""",
)
def rule_violations(t: Tables):
    rows = t.lineitem.withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    rules = {
        "quantity": P.between(F.col("l_quantity"), 2, 48),
        "returnflag": P.domain(F.col("l_returnflag"), ["A", "N"]),
        "discount": F.col("l_discount") <= 0.09,
    }
    return P.rule_violations(rows, "id", rules).groupBy("violation").agg(F.count(F.lit(1)).alias("rows"))


_RID = "'cr_' || substr(sha256(CASE WHEN doi IS NOT NULL THEN 'doi:' || doi WHEN nt <> '' THEN 'title-year:' || nt || ':' || year END), 1, 24)"


@query(
    "record_id_rules",
    f"""WITH {RECORDS_SQL}, n AS (SELECT *, trim(regexp_replace(strip_accents(lower(title)), '[^a-z0-9ß]+', ' ', 'g')) AS nt FROM records),
    s AS (SELECT CASE record_id % 10 WHEN 3 THEN 'cr_short' WHEN 5 THEN 'cr_' || substr(sha256('x' || record_id), 1, 24) ELSE {_RID} END AS sid, {_RID} AS want FROM n),
    v AS (SELECT sid, 'pattern' AS violation FROM s WHERE NOT regexp_full_match(coalesce(sid, ''), 'cr_[a-f0-9]{{24}}') UNION ALL SELECT sid, 'recomputed' FROM s WHERE sid IS DISTINCT FROM want)
    SELECT violation, count(*) AS records FROM v GROUP BY 1 UNION ALL SELECT 'duplicate', CAST(sum(c) AS BIGINT) FROM (SELECT sid, count(*) AS c FROM s GROUP BY 1 HAVING count(*) > 1)""",
)
def record_id_rules(t: Tables):
    good = S.record_id(S.record_identity(F.col("doi"), F.col("title"), F.col("year")))
    k = F.col("record_id") % 10
    fake = F.concat(F.lit("cr_"), F.substring(F.sha2(F.concat(F.lit("x"), "record_id"), 256), 1, 24))
    stored = F.when(k == 3, "cr_short").when(k == 5, fake).otherwise(good)
    bad = P.record_ids(records(t).withColumn("stored_id", stored))
    return bad.groupBy("violation").agg(F.sum("rows").alias("records"))


@query(
    "saturation_identities",
    """WITH r AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), v AS (SELECT unnest([CASE WHEN user_id % 4 = 0 THEN 'issued' END, CASE WHEN user_id % 5 = 0 THEN 'candidates' END, CASE WHEN user_id % 6 = 0 THEN 'reached' END]) AS violation, user_id FROM r)
    SELECT user_id AS topic_id, violation FROM v WHERE violation IS NOT NULL""",
)
def saturation_identities(t: Tables):
    n = F.col("topic_id")
    curve = t.events.select(F.col("user_id").alias("topic_id"))
    reports = curve.groupBy("topic_id").agg(F.count(F.lit(1)).alias("rows")).select(
        "topic_id",
        (F.col("rows") + F.when(n % 4 == 0, 1).otherwise(0)).alias("queries_issued"),
        F.lit(3).alias("topical_confirmed"),
        F.lit(4).alias("topical_rejected"),
        F.when(n % 5 == 0, 8).otherwise(7).alias("topical_candidates"),
        (n % 6 == 0).alias("saturation_reached"),
        F.lit("call_cap").alias("stop_reason"),
    )
    return P.saturation_identities(reports, curve)


@query(
    "full_record_rules",
    """WITH i AS (SELECT o_orderkey AS k, list_transform(range(0, o_custkey % 4), lambda i: (o_orderkey + i) % 5 <> 0) AS m, o_orderkey % 3 AS rules FROM orders),
    v AS (SELECT unnest([CASE WHEN len(m) = 0 THEN 'implementation' END, CASE WHEN list_contains(m, FALSE) THEN 'metrics' END, CASE WHEN rules = 0 THEN 'hard_rule' END, CASE WHEN k % 2 = 0 AND k % 7 = 0 THEN 'terms' END]) AS violation FROM i)
    SELECT violation, count(*) AS topics FROM v WHERE violation IS NOT NULL GROUP BY 1""",
)
def full_record_rules(t: Tables):
    k = F.col("o_orderkey")
    terms = F.when(k % 7 != 0, F.array(F.lit("term"))).otherwise(F.array().cast("array<string>"))
    docs = t.orders.select(
        k.alias("topic_id"), *full_record(k, F.col("o_custkey")), (k % 2 == 0).alias("has_dossier"), terms.alias("evidence_terms")
    )
    return P.full_record_rules(docs).groupBy("violation").agg(F.count(F.lit(1)).alias("topics"))


@query(
    "dossier_rules",
    """WITH d AS (SELECT o_custkey AS topic_id, count(*) AS a, count_if(o_orderstatus = 'F') AS b FROM orders GROUP BY 1), c AS (SELECT user_id AS topic_id, count(*) AS n, count_if(event_type = 'error' AND value > 60) AS dis FROM events GROUP BY 1),
    v AS (SELECT unnest([CASE WHEN topic_id % 10 = 0 THEN 'axis_sum' END, CASE WHEN c_custkey IS NULL THEN 'roster' END, CASE WHEN coalesce(n, 0) = 0 THEN 'corpus' END, CASE WHEN coalesce(dis, 0) = 0 THEN 'dissent' END]) AS violation
      FROM d LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) r ON c_custkey = topic_id LEFT JOIN c USING (topic_id))
    SELECT violation, count(*) AS dossiers FROM v WHERE violation IS NOT NULL GROUP BY 1""",
)
def dossier_rules(t: Tables):
    d = t.orders.groupBy(F.col("o_custkey").alias("topic_id")).agg(F.count(F.lit(1)).alias("a"), F.count_if(F.col("o_orderstatus") == "F").alias("b"))
    d = d.withColumn("total", F.col("a") + F.col("b") + F.when(F.col("topic_id") % 10 == 0, 1).otherwise(0))
    roster = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("topic_id"))
    corpus = t.events.groupBy(F.col("user_id").alias("topic_id")).agg(
        F.count(F.lit(1)).alias("records"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 60)).alias("dissent_records")
    )
    return P.dossier_rules(d, roster, corpus, ["a", "b"]).groupBy("violation").agg(F.count(F.lit(1)).alias("dossiers"))


@query(
    "coverage_ledger_rules",
    """WITH c AS (SELECT DISTINCT user_id % 20 AS topic_id, user_id AS record_id, event_type AS mode, CASE WHEN value < 95 THEN 'processed' ELSE 'skipped_irrelevant' END AS state FROM events),
    known AS (SELECT DISTINCT user_id % 20 AS topic_id, user_id AS record_id FROM events WHERE user_id % 11 <> 0),
    v AS (SELECT 'unknown_record' AS violation FROM c WHERE (topic_id, record_id) NOT IN (SELECT (topic_id, record_id) FROM known)
      UNION ALL SELECT 'two_states' FROM (SELECT record_id, mode FROM c GROUP BY 1, 2 HAVING count(DISTINCT state) > 1) UNION ALL SELECT 'mode_outside_topic' FROM c WHERE record_id % 13 = 0)
    SELECT violation, count(*) AS entries FROM v GROUP BY 1""",
)
def coverage_ledger_rules(t: Tables):
    rows = t.events.select(
        (F.col("user_id") % 20).alias("topic_id"),
        F.lit("evidence").alias("kind"),
        F.col("event_type").alias("mode"),
        F.lit(None).cast("string").alias("effect_id"),
        F.col("user_id").alias("record_id"),
        F.when(F.col("value") < 95, "processed").otherwise("skipped_irrelevant").alias("state"),
    ).distinct()
    top = rows.filter("record_id % 13 <> 0").withColumn("mode", F.lit(None).cast("string")).distinct()
    known = t.events.filter("user_id % 11 <> 0").select((F.col("user_id") % 20).alias("topic_id"), F.col("user_id").alias("record_id"))
    bad = P.coverage_ledger(rows.unionByName(top), known)
    # The topic level repeats the finding of its modes; the modes are what is counted.
    modes = P.coverage_ledger(rows, known).filter("violation <> 'mode_outside_topic'")
    loose = bad.filter("violation = 'mode_outside_topic'")
    return modes.unionByName(loose).groupBy("violation").agg(F.count(F.lit(1)).alias("entries"))


@query(
    "rejection_log_rules",
    "SELECT conv_id || ':' || turn AS log_id, 'quote_normalized' AS violation FROM conversations WHERE turn % 4 = 1 UNION ALL SELECT conv_id || ':' || turn, 'source_normalized' FROM conversations WHERE turn % 4 = 2",
)
def rejection_log_rules(t: Tables):
    base = t.conversations.select(F.concat_ws(":", "conv_id", "turn").alias("log_id"), "turn", "text")
    log = sinks.rejection_log(base, F.col("text"), F.concat(F.col("text"), F.lit(" tail")))
    k = F.col("turn") % 4
    log = log.withColumn("quote_normalized", F.when(k == 1, "old rules").otherwise(F.col("quote_normalized")))
    log = log.withColumn("source_normalized", F.when(k == 2, "old rules").otherwise(F.col("source_normalized")))
    return P.rejection_log(log)


@query(
    "run_ledger_links",
    """WITH runs AS (SELECT o_orderkey AS run_id, o_orderpriority = '5-LOW' AS probe, o_totalprice > 300000 AS fetched FROM orders), led AS (SELECT DISTINCT l_orderkey AS run_id, l_orderkey % 50 <> 0 AS balanced FROM lineitem WHERE l_linenumber < 6 UNION ALL SELECT -1, TRUE)
    SELECT run_id, 'no_ledger' AS violation FROM runs WHERE NOT probe AND run_id NOT IN (SELECT run_id FROM led) UNION ALL SELECT run_id, 'no_run' FROM led WHERE run_id NOT IN (SELECT run_id FROM runs)
    UNION ALL SELECT run_id, 'unbalanced' FROM led WHERE NOT balanced UNION ALL SELECT run_id, 'probe_has_ledger' FROM runs WHERE probe AND run_id IN (SELECT run_id FROM led) UNION ALL SELECT run_id, 'probe_fetched' FROM runs WHERE probe AND fetched""",
)
def run_ledger_links(t: Tables):
    runs = t.orders.select(
        F.col("o_orderkey").alias("run_id"), (F.col("o_orderpriority") == "5-LOW").alias("probe"), F.when(F.col("o_totalprice") > 300000, 1).otherwise(0).alias("records_fetched")
    )
    entries = t.lineitem.filter("l_linenumber < 6").select(F.col("l_orderkey").alias("run_id"), (F.col("l_orderkey") % 50 != 0).alias("balanced")).distinct()
    stray = t.region.limit(1).select(F.lit(-1).cast("bigint").alias("run_id"), F.lit(True).alias("balanced"))
    return P.run_ledger_links(runs, entries.unionByName(stray))


@query(
    "source_mode_rules",
    "SELECT DISTINCT user_id AS source_id, CASE WHEN user_id % 7 = 0 THEN 'unknown_source' ELSE 'wrong_mode' END AS violation FROM events WHERE user_id % 7 = 0 OR user_id % 5 = 0",
)
def source_mode_rules(t: Tables):
    users = t.events.select(F.col("user_id").alias("source_id")).distinct()
    declared = users.filter("source_id % 7 <> 0").withColumn("mode", F.when(F.col("source_id") % 5 == 0, "manual").otherwise("api"))
    return P.source_modes(t.events.select(F.col("user_id").alias("source_id")), declared, ["api"])


@query(
    "segment_rules",
    """WITH s AS (SELECT p_brand || p_type AS segment FROM part WHERE p_size = 1), c AS (SELECT p_brand || p_type AS segment FROM part WHERE p_size = 2)
    SELECT segment, 'duplicate_segment' AS violation FROM s GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT segment, 'duplicate_candidate' FROM c GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT segment, 'already_segment' FROM c WHERE segment IN (SELECT segment FROM s)""",
)
def segment_rules(t: Tables):
    named = lambda size: t.part.filter(F.col("p_size") == size).select(F.concat("p_brand", "p_type").alias("segment"))
    return P.segment_rules(named(1), named(2))


@query(
    "pack_rules",
    """WITH p AS (SELECT p_type AS pack, l_suppkey AS topic_id, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity = 50 GROUP BY 1, 2)
    SELECT pack, topic_id, 'duplicate_member' AS violation, 1 AS rows FROM p WHERE n > 1 UNION ALL SELECT pack, topic_id, 'unknown_member', n FROM p WHERE topic_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
    UNION ALL SELECT pack, topic_id, 'cross_cutting_member', n FROM p WHERE topic_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 9000) UNION ALL SELECT pack, topic_id, 'reserved_id', n FROM p WHERE pack = 'PROMO'""",
)
def pack_rules(t: Tables):
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("pack"))
    packs = t.lineitem.filter("l_quantity = 50").select("l_partkey", F.col("l_suppkey").alias("topic_id")).join(part, "l_partkey").select("pack", "topic_id")
    known = t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("topic_id"))
    crossing = t.supplier.filter("s_acctbal > 9000").select(F.col("s_suppkey").alias("topic_id"))
    bad = P.pack_rules(packs, known, crossing, "PROMO")
    return bad.groupBy("pack", "topic_id", "violation").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "interaction_rules",
    """WITH p AS (SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS a, CAST(c_nationkey AS VARCHAR) AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity = 50 AND l_extendedprice > 90000),
    v AS (SELECT 'same_ends' AS violation FROM p WHERE a = b UNION ALL SELECT 'unsorted' FROM p WHERE a > b UNION ALL SELECT 'name' FROM p WHERE CAST(a AS INTEGER) % 6 = 0
      UNION ALL SELECT 'duplicate_pair' FROM (SELECT least(a, b), greatest(a, b) FROM p GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'unknown_member' FROM (SELECT a AS k FROM p UNION ALL SELECT b FROM p) WHERE CAST(k AS INTEGER) > 20)
    SELECT violation, count(*) AS pairs FROM v GROUP BY 1""",
)
def interaction_rules(t: Tables):
    pairs = trade_edges(t).select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    pairs = pairs.withColumn("name", F.when(F.col("a").cast("int") % 6 == 0, "other").otherwise(F.concat_ws("__", "a", "b")))
    roster = t.nation.filter("n_nationkey <= 20").select(F.col("n_nationkey").cast("string").alias("topic_id"))
    return P.interaction_rules(pairs, roster).groupBy("violation").agg(F.count(F.lit(1)).alias("pairs"))


@query(
    "artifact_links",
    """WITH d AS (SELECT o_orderkey AS e, unnest([o_orderkey * 2, o_orderkey * 2 + 1]) AS r FROM orders), v AS (SELECT 'not_referenced_back' AS violation FROM d WHERE r % 10 = 0 UNION ALL SELECT 'not_listed_by_effect' FROM d WHERE r % 11 = 0 AND r % 10 <> 0
      UNION ALL SELECT 'inference_missing' FROM d WHERE r % 8 = 0 UNION ALL SELECT 'source_not_cited' FROM orders WHERE o_orderkey % 9 = 0)
    SELECT violation, count(*) AS rows FROM v GROUP BY 1""",
)
def artifact_links(t: Tables):
    """Orders as effects with two realizations each; some links are cut on purpose."""
    e = F.col("o_orderkey")
    both = F.array(e * 2, e * 2 + 1)
    cited = F.when(e % 9 == 0, F.array(F.lit("10.1/b"))).otherwise(F.array(F.lit("10.1/a"), F.lit("10.1/b")))
    effects = t.orders.select(
        e.alias("effect_id"),
        F.array(F.lit("10.1/a"), F.lit("10.1/b")).alias("sources"),
        cited.alias("cited_dois"),
        F.filter(both, lambda r: (r % 11 != 0) | (r % 10 == 0)).alias("realization_ids"),
    )
    r = F.col("realization_id")
    refs = F.when(r % 10 != 0, F.array("effect_id")).otherwise(F.array().cast("array<bigint>"))
    realizations = t.orders.select(e.alias("effect_id"), F.explode(both).alias("realization_id")).select(
        "realization_id", refs.alias("effect_refs"), F.lit("inferred").alias("derivation"), (r % 8 != 0).alias("has_inference")
    )
    return P.artifact_links(effects, realizations).groupBy("violation").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "proposal_rules",
    f"""WITH {CITATION_SQL}, p AS (SELECT DISTINCT item_id FROM cit), x AS (SELECT item_id, item_id % 3 <> 0 AS pipeline, item_id % 4 <> 0 AS late, item_id % 10 = 4 AS legacy FROM p)
    SELECT item_id, 'payload_differs' AS violation FROM p WHERE item_id % 12 = 5 UNION SELECT item_id, 'span_missing' FROM cit JOIN x USING (item_id) WHERE pipeline AND NOT legacy AND span_start IS NULL
    UNION SELECT item_id, 'role_missing' FROM cit JOIN x USING (item_id) WHERE pipeline AND late AND NOT legacy AND span_role IS NULL""",
)
def proposal_rules(t: Tables):
    c = citations(t)
    i = F.col("item_id")
    p = c.select("item_id").distinct().select(
        "item_id",
        F.concat(F.lit('{"n":'), i, F.lit("}")).alias("payload_json"),
        F.concat(F.lit('{"n":'), i + F.when(i % 12 == 5, 1).otherwise(0), F.lit("}")).alias("envelope_json"),
        F.when(i % 3 != 0, "extraction:7").otherwise("owner").alias("proposed_by"),
        F.to_timestamp(F.when(i % 4 != 0, "2026-08-01").otherwise("2026-07-01")).alias("proposed_at"),
        F.concat(F.lit("s"), i % 10).alias("signature"),
    )
    legacy = p.filter("signature = 's4'").select("signature")
    return P.proposal_rules(p, c, legacy)


@query(
    "span_tally",
    f"""WITH {CITATION_SQL}, a AS (SELECT c.*, source_text FROM cit c LEFT JOIN src USING (record_id))
    SELECT count_if(span_start IS NOT NULL) AS with_span, count_if(span_start IS NULL) AS without_span, count_if(span_start IS NOT NULL AND sha256(source_text) <> source_sha256) AS stale,
    count_if(span_start IS NOT NULL AND span_end > length(source_text)) AS out_of_range, count_if(span_end <= length(source_text) AND substr(source_text, span_start + 1, span_end - span_start) <> quote) AS does_not_reslice FROM a""",
)
def span_tally(t: Tables):
    keyed = citations(t).withColumn("cid", F.concat_ws(":", "item_id", "pos"))
    return P.span_tally(G.span_audit(keyed, sources(t).select("record_id", "source_text"), "cid"))


@query(
    "transition_rules",
    """WITH d AS (SELECT l_orderkey AS item_id, CASE WHEN l_linenumber % 2 = 0 THEN 'rejected' ELSE 'approved' END AS decision, l_returnflag = 'N' AS blank FROM lineitem),
    s AS (SELECT o_orderkey AS item_id, o_orderkey % 6 IN (0, 1) AS open FROM orders WHERE o_orderstatus <> 'P'), v AS (SELECT unnest([CASE WHEN open IS NULL THEN 'unknown_proposal' END, CASE WHEN NOT open THEN 'not_open' END, CASE WHEN decision = 'rejected' AND blank THEN 'reason_missing' END]) AS violation FROM d LEFT JOIN s USING (item_id))
    SELECT violation, count(*) AS decisions FROM v WHERE violation IS NOT NULL GROUP BY 1""",
)
def transition_rules(t: Tables):
    decisions = t.lineitem.select(
        F.col("l_orderkey").alias("item_id"),
        F.when(F.col("l_linenumber") % 2 == 0, "rejected").otherwise("approved").alias("decision"),
        F.when(F.col("l_returnflag") == "N", " ").otherwise(F.col("l_returnflag")).alias("note"),
    )
    proposals = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("item_id"), status_of(F.col("o_orderkey")).alias("status"))
    return P.transition_rules(decisions, proposals).groupBy("violation").agg(F.count(F.lit(1)).alias("decisions"))


# --- replay ---------------------------------------------------------------------------------
@query(
    "replay_gate",
    f"WITH {_GATE_SQL}, l AS (SELECT item_id, CASE WHEN item_id % 6 = 0 THEN 'doi_unresolved' ELSE reason END AS logged, reason FROM gate WHERE reason IS NOT NULL) SELECT logged = reason AS same, count(*) AS refusals FROM l GROUP BY 1",
)
def replay_gate(t: Tables):
    """Re-run the gate over its own log, part of which was written under other rules."""
    gate = G.grounding_gate(*gate_inputs(t)).filter("reason IS NOT NULL")
    logged = F.when(F.col("item_id") % 6 == 0, "doi_unresolved").otherwise(F.col("reason"))
    return gate.groupBy((logged == F.col("reason")).alias("same")).agg(F.count(F.lit(1)).alias("refusals"))


_BASE = f"""b AS (SELECT doc_id, lang, text, '10.5555/' || doc_id AS doi, substr(text, CAST(n_chars // 3 AS BIGINT) + 1, 120) AS quote FROM documents WHERE n_chars >= 200),
mu AS (SELECT doc_id, text, name, q, role, d FROM b, LATERAL (VALUES ('none', quote, 'finding', doi), ('whitespace_doubled', replace(quote, ' ', '  '), 'finding', doi), ('curly_quotes', '“' || quote || '”', 'finding', doi),
  ('trailing_ellipsis', quote || '…', 'finding', doi), ('nbsp', replace(quote, ' ', chr(160)), 'finding', doi), ('ligature_fi', quote, 'finding', doi), ('edge_punctuation', '"' || quote || '".', 'finding', doi), ('doi_case', quote, 'finding', 'DOI:' || doi),
  ('quote_invented', quote || ' zqx invented', 'finding', doi), ('quote_punctuation_only', '...', 'finding', doi), ('span_role_omitted', quote, NULL, doi), ('span_role_unknown_value', quote, 'opinion', doi), ('span_role_background', quote, 'background', doi)) v(name, q, role, d)),
rs AS (SELECT doc_id, name, CASE WHEN NOT contains({norm_sql('text')}, {norm_sql('q')}) THEN 'quote_not_in_source' WHEN role IS NULL OR role = 'opinion' THEN 'span_role_missing' WHEN role <> 'finding' THEN 'span_role_not_finding'
  WHEN starts_with(d, 'DOI') THEN 'doi_unresolved' WHEN {norm_sql('q')} = '' THEN 'quote_not_in_source' ELSE 'admitted' END AS reason FROM mu)"""


@query("tolerance_matrix", f"WITH {_BASE} SELECT name AS mutation, reason, count(*) AS candidates FROM rs GROUP BY 1, 2")
def tolerance_matrix(t: Tables):
    """Named mutations of quotes that are verbatim by construction, through the gate."""
    q, doi = F.col("quote"), F.col("r_doi")
    finding = F.lit("finding")

    def mutation(name, quote=q, role=finding, d=doi):
        return F.struct(F.lit(name).alias("mutation"), quote.alias("quote"), role.alias("span_role"), d.alias("doi"))

    missing = F.lit(None).cast("string")
    table = F.array(
        mutation("none"),
        mutation("whitespace_doubled", F.replace(q, F.lit(" "), F.lit("  "))),
        mutation("curly_quotes", F.concat(F.lit("“"), q, F.lit("”"))),
        mutation("trailing_ellipsis", F.concat(q, F.lit("…"))),
        mutation("nbsp", F.replace(q, F.lit(" "), F.lit(" "))),
        mutation("ligature_fi", F.replace(q, F.lit("fi"), F.lit("ﬁ"))),
        mutation("edge_punctuation", F.concat(F.lit('"'), q, F.lit('".'))),
        mutation("doi_case", d=F.concat(F.lit("DOI:"), doi)),
        mutation("quote_invented", F.concat(q, F.lit(" zqx invented"))),
        mutation("quote_punctuation_only", F.lit("...")),
        mutation("span_role_omitted", role=missing),
        mutation("span_role_unknown_value", role=F.lit("opinion")),
        mutation("span_role_background", role=F.lit("background")),
    )
    start = F.floor(F.col("n_chars") / 3)
    base = t.documents.filter("n_chars >= 200").select(
        F.col("doc_id").alias("record_id"),
        F.col("lang").alias("topic_id"),
        F.substring("text", (start + 1).cast("int"), F.lit(120)).alias("quote"),
        F.concat(F.lit("10.5555/"), "doc_id").alias("r_doi"),
    )
    mutated = base.select("record_id", "topic_id", F.inline(table)).withColumn("item_id", F.concat_ws(":", "record_id", "mutation"))
    none = F.lit(None).cast("bigint")
    cites = mutated.select(
        "item_id", F.lit(0).alias("pos"), "record_id", "topic_id", "quote", "span_role", none.alias("start"), none.alias("end"), "doi",
        F.lit("t").alias("title"), missing.alias("source_sha256"),
    )
    recs = t.documents.select(
        F.col("doc_id").alias("record_id"), F.col("text").alias("source_text"), F.col("lang").alias("r_topic_id"), F.lit("t").alias("r_title"),
        F.concat(F.lit("10.5555/"), "doc_id").alias("r_doi"),
    )
    gate = G.grounding_gate(mutated.select("item_id", "mutation"), cites, recs)
    return gate.groupBy("mutation", F.coalesce("reason", F.lit("admitted")).alias("reason")).agg(F.count(F.lit(1)).alias("candidates"))


# --- projections ------------------------------------------------------------------------------
@query(
    "pack_datasheet",
    """WITH m AS (SELECT n_regionkey AS pack, array_to_string(list(n_name ORDER BY n_nationkey), ',') AS members FROM nation GROUP BY 1),
    e AS (SELECT n_regionkey AS pack, count(*) AS effects, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS contexts FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1),
    r AS (SELECT n_regionkey AS pack, count(*) AS realizations FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1)
    SELECT pack, members, effects, contexts, coalesce(realizations, 0) AS realizations FROM m LEFT JOIN e USING (pack) LEFT JOIN r USING (pack)""",
)
def pack_datasheet(t: Tables):
    return datasheets(t)


def datasheets(t: Tables):
    nation = t.nation.select("n_nationkey", F.col("n_regionkey").alias("pack"), "n_name")
    members = nation.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("m"))
    members = members.select("pack", F.array_join(F.transform("m", lambda m: m["n_name"]), ",").alias("members"))
    effects = t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("pack").agg(
        F.count(F.lit(1)).alias("effects"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("contexts")
    )
    real = t.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("pack").agg(F.count(F.lit(1)).alias("realizations"))
    return members.join(effects, "pack", "left").join(real, "pack", "left").na.fill(0, ["realizations"])


@query(
    "datasheet_bundle",
    """WITH m AS (SELECT n_regionkey AS pack, array_to_string(list(n_name ORDER BY n_nationkey), ',') AS members FROM nation GROUP BY 1)
    SELECT CAST(pack AS VARCHAR) AS pack, '{"pack":' || pack || ',"members":"' || members || '"}' AS document FROM m UNION ALL SELECT 'manifest', '{"pack_count":5,"pack_ids":[0,1,2,3,4]}'""",
)
def datasheet_bundle(t: Tables):
    return sinks.datasheet_bundle(datasheets(t).select("pack", "members"), "pack")


@query(
    "registry_tree",
    "SELECT o_custkey AS parent, count_if(o_orderstatus = 'F') AS full_records, count_if(o_orderstatus <> 'F') AS stubs, count_if(o_orderstatus = 'F' AND o_totalprice > 100000) AS valid_records FROM orders GROUP BY 1",
)
def registry_tree(t: Tables):
    kind = F.when(F.col("o_orderstatus") == "F", "full").otherwise("stub")
    topics = t.orders.select(F.col("o_custkey").alias("parent"), kind.alias("kind"), (F.col("o_totalprice") > 100000).alias("valid"))
    return Q.registry_tree(topics)


@query(
    "maturation_entry",
    """WITH a AS (SELECT o_custkey AS pack, o_orderpriority AS segment, max(CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN o_orderstatus END) AS b, max(CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN o_orderstatus END) AS n FROM orders GROUP BY 1, 2),
    c AS (SELECT CASE b WHEN 'F' THEN 'green' ELSE b END AS b, CASE n WHEN 'F' THEN 'green' ELSE n END AS n FROM a WHERE b IS DISTINCT FROM n),
    e AS (SELECT count_if(event_type = 'purchase') AS run, count_if(event_type = 'click') AS defer, sum(CAST(value AS DECIMAL(18, 2))) AS s FROM events)
    SELECT count(*) AS cells_changed, count_if(n = 'green') AS turned_green, count_if(b = 'green') AS left_green, (SELECT run FROM e) AS dispatched, (SELECT defer FROM e) AS deferred, (SELECT CAST(s - 1000 AS DOUBLE) FROM e) AS spend_delta FROM c""",
)
def maturation_entry(t: Tables):
    green = F.when(F.col("status") == "F", "green").otherwise(F.col("status"))
    before, after = [s.withColumn("status", green) for s in _snapshots(t)]
    action = F.when(F.col("event_type") == "purchase", "run").when(F.col("event_type") == "click", "defer")
    queues = t.events.select(action.alias("action"), F.col("value").cast("decimal(18,2)").alias("usd"))
    return Q.maturation_entry(before, after, 1000.0, F.sum("usd").cast("double"), queues)


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "file_checklist",
    f"""WITH f AS (SELECT user_id AS path, {', '.join(f"count_if(event_type = '{e}' AND value > 60) AS c{i}" for i, e in enumerate(_TYPES))} FROM events GROUP BY 1),
    u AS (SELECT path, unnest(['foundational', 'meta-analysis', 'replication', 'dissent', 'recent']) AS category, unnest([c0, c1, c2, c3, c4]) AS n FROM f)
    SELECT path, category, CASE WHEN path % 9 = 0 THEN 'unclassified' WHEN n > 0 THEN 'covered' ELSE 'missing' END AS state FROM u""",
)
def file_checklist(t: Tables):
    known = F.col("user_id") % 9 != 0
    counts = [
        F.when(F.first(known), F.count_if((F.col("event_type") == e) & (F.col("value") > 60))).alias(c) for e, c in zip(_TYPES, V.CATEGORIES)
    ]
    return Q.file_checklist(t.events.groupBy("user_id").agg(*counts).withColumnRenamed("user_id", "path"))


@query(
    "uncovered_phrases",
    f"""WITH w AS (SELECT lang, string_split({norm_sql('text')}, ' ') AS w FROM documents), g AS (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS phrase FROM w WHERE len(w) >= 3),
    bw AS (SELECT string_split({norm_sql('text')}, ' ') AS w FROM benchmark), b AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS phrase FROM bw WHERE len(w) >= 3)
    SELECT phrase, count(DISTINCT lang) AS topics, count(*) AS occurrences FROM g WHERE phrase NOT IN (SELECT phrase FROM b) GROUP BY 1 HAVING count(DISTINCT lang) >= 2""",
)
def uncovered_phrases(t: Tables):
    texts = t.documents.select(F.col("lang").alias("topic_id"), "text")
    return Q.uncovered_phrases(texts, t.benchmark.select("text"), 3, 2)


DESIGNS = ["meta_analysis", "rct", "quasi_experiment", "observational", "narrative_review", "theoretical"]


@query(
    "computed_grade",
    """WITH c AS (SELECT l_orderkey AS item_id, l_suppkey AS doi, 5 - l_linenumber % 6 AS design, CASE WHEN l_tax > 0.06 THEN 'contradicts' ELSE 'supports' END AS dir, l_returnflag = 'R' AS rep FROM lineitem),
    f AS (SELECT item_id, count(DISTINCT doi) AS dois, max(design) AS best, count(DISTINCT dir) = 1 AS ok, bool_or(rep) AS rep FROM c GROUP BY 1)
    SELECT item_id, dois, CASE WHEN dois >= 2 AND (best = 5 OR (dois >= 3 AND ok AND rep)) THEN 'A' WHEN dois >= 2 AND ok AND best >= 3 THEN 'B' ELSE 'C' END AS band FROM f""",
)
def computed_grade(t: Tables):
    c = t.lineitem.select(
        F.col("l_orderkey").alias("item_id"),
        F.col("l_suppkey").alias("doi"),
        F.get(X.literals(DESIGNS), (F.col("l_linenumber") % 6).cast("int")).alias("study_design"),
        F.when(F.col("l_tax") > 0.06, "contradicts").otherwise("supports").alias("direction"),
        (F.col("l_returnflag") == "R").alias("replication"),
    )
    return Q.computed_grade(c)
