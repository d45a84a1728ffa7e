"""Filters, duplicate resolution, joins and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.functions import scalars as S
from corroborate.functions import text as X
from corroborate.functions import vocabulary as V
from corroborate.operators import classify as C
from corroborate.operators import entity as E
from corroborate.operators import relational as R
from corroborate.operators.skew import skew_join
from corroborate.plans.registry import Tables, query
from corroborate.plans.views import KEYED_SQL, NOW_YEAR, RECORDS_SQL, keyed_records, norm_sql, records

# --- filters -----------------------------------------------------------------------


@query(
    "eligible_records",
    f"WITH {RECORDS_SQL} SELECT record_id FROM records WHERE trim(coalesce(abstract, ''), ' ' || chr(10)) <> ''",
)
def eligible_records(t: Tables):
    return R.eligible_records(records(t), "abstract").select("record_id")


@query(
    "mode_eligible",
    "SELECT o_orderkey AS topic_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
)
def mode_eligible(t: Tables):
    topics = t.orders.select(F.col("o_orderkey").alias("topic_id"))
    done = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("topic_id"))
    return R.mode_eligible(topics, done)


def _scope_tables(t: Tables):
    """customers as topics in packs (market segments); rich ones cut across packs."""
    topics = t.customer.select(F.col("c_custkey").alias("topic_id"))
    packs = t.customer.select(F.col("c_mktsegment").alias("pack"), F.col("c_custkey").alias("topic_id"))
    crossing = t.customer.filter("c_acctbal > 9000").select(F.col("c_custkey").alias("topic_id"))
    effects = t.orders.select(F.col("o_orderpriority").alias("effect_id"), F.col("o_custkey").alias("topic_id"))
    return topics, packs, crossing, effects


_SCOPE_SQL = """t AS (SELECT c_custkey AS topic_id FROM customer WHERE c_custkey % 13 <> 0),
p AS (SELECT DISTINCT c_mktsegment AS ident, c_custkey AS topic_id FROM customer),
x AS (SELECT c_custkey AS topic_id FROM customer WHERE c_acctbal > 9000),
e AS (SELECT DISTINCT 'E' || o_custkey AS ident, o_custkey AS topic_id FROM orders),
s AS (SELECT n_name AS ident, CASE WHEN n_regionkey = 2 THEN 'retired' ELSE 'active' END AS status FROM nation),
r AS (SELECT DISTINCT 'pack' AS kind, c_mktsegment AS ident FROM customer UNION SELECT DISTINCT 'pack', o_orderpriority FROM orders UNION SELECT 'segment', n_name FROM nation UNION SELECT 'segment', r_name FROM region
  UNION SELECT 'effect', 'E' || c_custkey FROM customer UNION SELECT 'topic', CAST(o_custkey AS VARCHAR) FROM orders UNION SELECT 'shelf', r_name FROM region),
n AS (
  SELECT r.kind, r.ident, t.topic_id FROM r JOIN t ON r.kind = 'topic' AND r.ident = CAST(t.topic_id AS VARCHAR)
  UNION SELECT r.kind, r.ident, topic_id FROM r JOIN e USING (ident) JOIN t USING (topic_id) WHERE r.kind = 'effect'
  UNION SELECT r.kind, r.ident, topic_id FROM r JOIN p USING (ident) JOIN t USING (topic_id) WHERE r.kind = 'pack'
  UNION SELECT r.kind, r.ident, topic_id FROM r, x JOIN t USING (topic_id) WHERE r.kind = 'pack' AND r.ident IN (SELECT ident FROM p)
  UNION SELECT r.kind, r.ident, topic_id FROM r JOIN s USING (ident), t WHERE r.kind = 'segment' AND status = 'active' AND (topic_id IN (SELECT topic_id FROM p) OR topic_id IN (SELECT topic_id FROM x)))
SELECT kind, ident, topic_id, NULL AS refused FROM n
UNION ALL SELECT kind, ident, NULL, CASE WHEN kind = 'pack' AND ident IN (SELECT ident FROM p) THEN NULL WHEN kind = 'segment' AND ident IN (SELECT ident FROM s WHERE status = 'active') THEN NULL
  WHEN kind = 'segment' THEN 'unknown_active_segment' WHEN kind = 'effect' AND ident IN (SELECT ident FROM e) THEN 'effect_without_full_topic' WHEN kind = 'shelf' THEN 'unknown_kind' ELSE 'unknown_' || kind END
  FROM r WHERE (kind, ident) NOT IN (SELECT kind, ident FROM n)"""


@query("resolve_scope", f"WITH {_SCOPE_SQL}")
def resolve_scope(t: Tables):
    topics, packs, crossing, _ = _scope_tables(t)
    effects = t.orders.select(F.concat(F.lit("E"), "o_custkey").alias("effect_id"), F.col("o_custkey").alias("topic_id"))
    segments = t.nation.select(F.col("n_name").alias("segment"), F.when(F.col("n_regionkey") == 2, "retired").otherwise("active").alias("status"))
    named = [("pack", packs, "pack"), ("pack", t.orders, "o_orderpriority"), ("segment", t.nation, "n_name"), ("segment", t.region, "r_name"), ("effect", t.customer.withColumn("effect", F.concat(F.lit("E"), "c_custkey")), "effect"), ("topic", t.orders, "o_custkey"), ("shelf", t.region, "r_name")]
    requests = reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("ident")) for kind, df, c in named])
    return R.resolve_scopes(requests, topics.filter("topic_id % 13 <> 0"), packs, crossing, effects, segments)


_REVIEW_TITLE = V.META_ANALYSIS_TITLE.replace("'", "''")
_CHAPTER_TITLE = V.REVIEW_CHAPTER_TITLE.replace("'", "''")
REVIEW_SQL = f"""(openalex_type = 'review' OR regexp_matches(title, '(?i){_REVIEW_TITLE}')
  OR (openalex_type IN ('book-chapter', 'reference-entry', 'book') AND regexp_matches(title, '(?i){_CHAPTER_TITLE}')))"""
FOUNDATIONAL_SQL = f"""coalesce(citations >= 1000 OR ({NOW_YEAR} - year >= 10 AND citations >= 250
  AND citations / ({NOW_YEAR} - year) >= 20), FALSE)"""


@query("is_review_like", f"WITH {RECORDS_SQL} SELECT record_id, {REVIEW_SQL} AS review FROM records")
def is_review_like(t: Tables):
    return records(t).select("record_id", C.is_review_like(F.col("title"), F.col("openalex_type")).alias("review"))


@query(
    "is_foundational",
    f"WITH {RECORDS_SQL} SELECT record_id, {FOUNDATIONAL_SQL} AS foundational FROM records",
)
def is_foundational(t: Tables):
    found = C.is_foundational(F.col("citations"), F.col("year"), NOW_YEAR)
    return records(t).select("record_id", found.alias("foundational"))


@query("is_recent", f"WITH {RECORDS_SQL} SELECT record_id, year >= {NOW_YEAR - 5} AS recent FROM records")
def is_recent(t: Tables):
    return records(t).select("record_id", C.is_recent(F.col("year"), NOW_YEAR).alias("recent"))


# Frequent words of the driver's invented languages, used as topic keywords.
KEYWORDS = ["that", "with", "this", "unos", "nicht", "dans"]
_HITS = "len(list_filter(['that','with','this','unos','nicht','dans'], lambda k: list_contains(string_split_regex(lower({0}), '[^a-z0-9]+'), k)))"


@query(
    "is_topical",
    f"""WITH {RECORDS_SQL}, h AS (SELECT *, {_HITS.format('title')} AS th, {_HITS.format("coalesce(abstract, '')")} AS ah FROM records)
    SELECT record_id, coalesce(abstract, '') <> '' AND th >= 1 AND ah >= 2 AS topical_review,
    openalex_id IS NOT NULL AND coalesce(abstract, '') <> '' AND th >= 2 AND ah >= 3 AS topical_anchor FROM h""",
)
def is_topical(t: Tables):
    keys = X.literals(KEYWORDS)
    return records(t).select(
        "record_id",
        C.is_topical_review(F.col("title"), F.col("abstract"), keys).alias("topical_review"),
        C.is_topical_anchor(F.col("openalex_id"), F.col("title"), F.col("abstract"), keys).alias("topical_anchor"),
    )


@query(
    "proposal_status_sets",
    """WITH s AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'edited' WHEN 2 THEN 'held_low_confidence'
      WHEN 3 THEN 'approved' WHEN 4 THEN 'rejected' ELSE 'held_non_transferable' END AS status, o_orderkey % 2 = 0 AS pipeline, o_orderdate FROM orders)
    SELECT o_orderkey, status IN ('pending', 'edited', 'held_low_confidence') AS live, status IN ('pending', 'edited') AS actionable,
    pipeline, pipeline AND o_orderdate >= TIMESTAMP '1998-01-01' AS role_due FROM s""",
)
def proposal_status_sets(t: Tables):
    from corroborate.operators.constraints import is_pipeline_authored, requires_role

    by = F.when(F.col("o_orderkey") % 2 == 0, "extraction:run").otherwise("owner")
    # The cut-off of the rule lies in 2026; order dates are moved there.
    shifted = F.to_timestamp(F.lit(V.SPAN_ROLE_REQUIRED_FROM)) + (F.col("o_orderdate").cast("timestamp") - F.to_timestamp(F.lit("1998-01-01")))
    p = t.orders.withColumn("status", status_of(F.col("o_orderkey"))).withColumn("by", by)
    return p.select(
        "o_orderkey",
        R.is_live(F.col("status")).alias("live"),
        R.is_actionable(F.col("status")).alias("actionable"),
        is_pipeline_authored(F.col("by")).alias("pipeline"),
        requires_role(F.col("by"), shifted).alias("role_due"),
    )


STATUSES = ["pending", "edited", "held_low_confidence", "approved", "rejected", "held_non_transferable"]


def status_of(key):
    return F.get(X.literals(STATUSES), (key % 6).cast("int"))


@query(
    "valid_full_records",
    """WITH i AS (SELECT o_orderkey, list_transform(range(0, o_custkey % 4), lambda i: (o_orderkey + i) % 5 <> 0) AS measured, o_orderkey % 3 AS rules FROM orders)
    SELECT o_orderkey, len(measured) > 0 AND NOT list_contains(measured, FALSE) AND rules > 0 AS valid FROM i""",
)
def valid_full_records(t: Tables):
    docs = t.orders.select("o_orderkey", *full_record(F.col("o_orderkey"), F.col("o_custkey")))
    return docs.select("o_orderkey", R.is_valid_full_record(F.col("implementations"), F.col("hard_rules")).alias("valid"))


def full_record(key, other):
    """Nested parts of a full record, built from the row itself."""
    none = F.array().cast("array<string>")
    count = (other % 4).cast("int")
    slots = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    made = F.transform(slots, lambda i: F.struct(F.when((key + i) % 5 != 0, F.array(F.lit("m"))).otherwise(none).alias("metrics")))
    rules = F.array_repeat(F.lit("rule"), (key % 3).cast("int"))
    return made.alias("implementations"), rules.alias("hard_rules")


@query(
    "bootstrap_segments",
    "SELECT DISTINCT p_brand AS segment FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 49 AND p_type = 'ECONOMY')",
)
def bootstrap_segments(t: Tables):
    segments = t.part.select(F.col("p_brand").alias("segment"), F.lit("active").alias("status")).distinct()
    stages = t.part.filter("p_size > 49 AND p_type = 'ECONOMY'").select(F.col("p_brand").alias("segment"))
    return R.bootstrap_segments(segments, stages).select("segment")


# --- entity resolution -----------------------------------------------------------------
# Min-label propagation over the three keys, to a fixed point, as a recursive CTE.
CLUSTER_SQL = f"""
{KEYED_SQL.strip()},
k AS (SELECT record_id, 'd' || doi AS key FROM keyed WHERE doi IS NOT NULL
  UNION ALL SELECT record_id, 'o' || openalex_id FROM keyed WHERE openalex_id IS NOT NULL
  UNION ALL SELECT record_id, 't' || title_key FROM keyed WHERE title_key IS NOT NULL),
star AS (SELECT key, min(record_id) AS center FROM k GROUP BY key),
edge AS (SELECT DISTINCT record_id AS a, center AS b FROM k JOIN star USING (key)
  UNION SELECT DISTINCT center, record_id FROM k JOIN star USING (key)),
reach AS (SELECT record_id AS node, record_id AS label FROM keyed
  UNION SELECT e.b, r.label FROM reach r JOIN edge e ON e.a = r.node),
cluster AS (SELECT node AS record_id, min(label) AS cluster_id FROM reach GROUP BY node)
"""


def resolved(t: Tables):
    return E.resolve_entities(keyed_records(t), "record_id", ["doi", "openalex_id", "title_key"])


@query(
    "resolve_entities",
    f"WITH RECURSIVE {CLUSTER_SQL} SELECT cluster_id, count(*) AS members, max(record_id) AS last_id FROM cluster GROUP BY cluster_id",
)
def resolve_entities(t: Tables):
    return (
        resolved(t)
        .groupBy("cluster")
        .agg(F.min("record_id").alias("cluster_id"), F.count(F.lit(1)).alias("members"), F.max("record_id").alias("last_id"))
        .drop("cluster")
    )


MERGED_SQL = f"""
{CLUSTER_SQL.strip()},
j AS (SELECT * FROM keyed JOIN cluster USING (record_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY coalesce(citations, -1) DESC, (doi IS NOT NULL) DESC, record_id) AS rn FROM j),
f AS (SELECT cluster_id, count(*) AS cluster_size,
  arg_min(doi, record_id) FILTER (WHERE doi IS NOT NULL) AS f_doi,
  arg_min(citations, record_id) FILTER (WHERE citations IS NOT NULL) AS f_citations,
  arg_min(abstract, record_id) FILTER (WHERE abstract IS NOT NULL) AS f_abstract,
  arg_min(openalex_id, record_id) FILTER (WHERE openalex_id IS NOT NULL) AS f_oid FROM j GROUP BY cluster_id),
merged AS (SELECT f.cluster_id, cluster_size, title, year, coalesce(doi, f_doi) AS doi, coalesce(citations, f_citations) AS citations,
  coalesce(abstract, f_abstract) AS abstract, coalesce(openalex_id, f_oid) AS openalex_id, openalex_type, source_api, topic_id
  FROM b JOIN f USING (cluster_id) WHERE rn = 1)
"""


def merged(t: Tables):
    return E.merge_cluster(resolved(t), ["cluster"], "record_id")


@query(
    "merge_cluster",
    f"""WITH RECURSIVE {MERGED_SQL} SELECT cluster_id, cluster_size, title, year, doi, citations, md5(coalesce(abstract, '')) AS abstract_md5,
    openalex_id, openalex_type, source_api FROM merged""",
)
def merge_cluster(t: Tables):
    return merged(t).select(
        F.col("record_id").alias("cluster_id"),
        "cluster_size",
        "title",
        "year",
        "doi",
        "citations",
        F.md5(F.coalesce("abstract", F.lit(""))).alias("abstract_md5"),
        "openalex_id",
        "openalex_type",
        "source_api",
    )


_PINS_SQL = f"""
{KEYED_SQL.strip()},
pins AS (SELECT item_id AS pin_id, '10.5555/' || substr(md5(text), 1, 12) AS doi,
  CASE WHEN position(chr(10) IN text) > 0 THEN substr(text, 1, position(chr(10) IN text) - 1) ELSE text END AS title, item_id * 100 AS citations FROM benchmark),
pk AS (SELECT *, nullif(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), '') AS title_key FROM pins
  UNION ALL SELECT 100000 + doc_id, doi, title, 50000, title_key FROM (SELECT record_id AS doc_id, doi, title, title_key FROM keyed WHERE source = 'src3')),
hit AS (SELECT pin_id, min(record_id) AS record_id FROM (
  SELECT pin_id, record_id FROM pk JOIN keyed USING (doi) UNION ALL SELECT pin_id, record_id FROM pk JOIN keyed USING (title_key)) GROUP BY pin_id),
own AS (SELECT record_id, max(pin_id) AS pin_id FROM hit GROUP BY record_id)
"""


def _pins(t: Tables):
    at = F.instr("text", "\n")
    title = F.when(at > 0, F.substring("text", F.lit(1), at - 1)).otherwise(F.col("text"))
    key = X.title_key(F.col("title"))
    bench = t.benchmark.select(
        F.col("item_id").alias("pin_id"),
        F.concat(F.lit("10.5555/"), F.substring(F.md5("text"), 1, 12)).alias("doi"),
        title.alias("title"),
        (F.col("item_id") * 100).alias("citations"),
    ).withColumn("title_key", F.when(key != "", key))
    known = keyed_records(t).filter("source = 'src3'").select(
        (F.lit(100000) + F.col("record_id")).alias("pin_id"), "doi", "title", F.lit(50000).cast("bigint").alias("citations"), "title_key"
    )
    return bench.unionByName(known).withColumn("pin_reason", F.concat(F.lit("pin "), F.col("pin_id")))


@query(
    "merge_pinned",
    f"""WITH {_PINS_SQL} SELECT coalesce('pin ' || own.pin_id, '') AS pin_reason, count(*) AS records,
      CAST(sum(CASE WHEN own.pin_id IS NULL THEN coalesce(k.citations, -1)
        ELSE greatest(coalesce(k.citations, -1), p.citations) END) AS BIGINT) AS citations,
      CASE WHEN own.pin_id IS NULL THEN 'as found' ELSE 'pinned' END AS origin, FALSE AS appended
    FROM keyed k LEFT JOIN own USING (record_id) LEFT JOIN pk p ON p.pin_id = own.pin_id GROUP BY 1, 4
    UNION ALL SELECT 'pin ' || pin_id, 1, citations, 'pinned', TRUE FROM pk WHERE pin_id NOT IN (SELECT pin_id FROM hit)""",
)
def merge_pinned(t: Tables):
    out = E.merge_pinned(keyed_records(t), _pins(t), "record_id")
    origin = F.when(F.col("source_api") == "pinned", "pinned").otherwise("as found")
    return out.groupBy(F.coalesce("pin_reason", F.lit("")).alias("pin_reason"), origin.alias("origin"), "appended").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.coalesce("citations", F.lit(-1))).alias("citations")
    )


_IDENT = "CASE WHEN doi IS NOT NULL THEN doi WHEN title_key IS NOT NULL THEN title_key || ':' || year END"


@query(
    "id_violations",
    f"""WITH {KEYED_SQL}, g AS (SELECT {_IDENT} AS identity, count(*) AS n FROM keyed GROUP BY 1)
    SELECT CASE WHEN identity IS NULL THEN 'empty_identity' ELSE 'duplicate_identity' END AS violation, count(*) AS ids, CAST(sum(n) AS BIGINT) AS records
    FROM g WHERE n > 1 OR identity IS NULL GROUP BY 1""",
)
def id_violations(t: Tables):
    identity = F.coalesce("doi", F.concat_ws(":", "title_key", F.when(F.col("title_key").isNotNull(), F.col("year"))))
    r = keyed_records(t).withColumn("identity", F.when(identity != "", identity))
    r = r.withColumn("stable_id", S.record_id(F.col("identity")))
    bad = E.id_violations(r, "identity", "stable_id")
    return bad.groupBy("violation").agg(F.count(F.lit(1)).alias("ids"), F.sum("rows").alias("records"))


_QUOTES_SQL = f"SELECT conv_id AS item_id, 'T' || (conv_id % 5) AS topic_id, role AS record_id, {norm_sql('text')} AS norm, turn AS pos, text FROM conversations"


@query(
    "union_citations",
    f"""WITH q AS ({_QUOTES_SQL} UNION ALL SELECT conv_id, 'T' || (conv_id % 5), role, {norm_sql('text')}, turn + 1000, text || ' !!' FROM conversations WHERE turn = 0)
    SELECT item_id, topic_id, record_id, md5(arg_max(text, pos)) AS quote_md5, max(pos) AS pos FROM q GROUP BY item_id, topic_id, record_id, norm""",
)
def union_citations(t: Tables):
    base = t.conversations.select(
        F.col("conv_id").alias("item_id"),
        F.concat(F.lit("T"), F.col("conv_id") % 5).alias("topic_id"),
        F.col("role").alias("record_id"),
        F.col("text").alias("quote"),
        F.col("turn").alias("pos"),
    )
    again = base.filter("pos = 0").withColumn("quote", F.concat("quote", F.lit(" !!"))).withColumn("pos", F.col("pos") + 1000)
    kept = E.union_citations(base.unionByName(again))
    return kept.select("item_id", "topic_id", "record_id", F.md5("quote").alias("quote_md5"), "pos")


@query(
    "register_spans",
    """WITH s AS (SELECT user_id AS item_id, event_type AS record_id, CAST(floor(value) AS BIGINT) % 20 AS span_start, event_id AS pos FROM events),
    u AS (SELECT item_id, record_id, span_start, min(pos) AS first_pos FROM s GROUP BY 1, 2, 3)
    SELECT item_id, record_id, span_start, 'p' || row_number() OVER (PARTITION BY item_id ORDER BY first_pos) AS ref FROM u""",
)
def register_spans(t: Tables):
    start = (F.floor("value") % 20).cast("bigint")
    spans = t.events.select(
        F.col("user_id").alias("item_id"),
        F.col("event_type").alias("record_id"),
        start.alias("start"),
        (start + 10).alias("end"),
        F.lit("finding").alias("span_role"),
        F.col("event_id").alias("pos"),
    )
    return E.register_spans(spans).select("item_id", "record_id", F.col("start").alias("span_start"), "ref")


@query(
    "merge_near_duplicates",
    f"""WITH p AS (SELECT a.conv_id, a.turn, a.text AS l, b.text AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
    SELECT conv_id, turn, md5(CASE WHEN length({norm_sql('r')}) > length({norm_sql('l')}) THEN r ELSE l END) AS fact_md5,
    greatest(turn % 7, (turn + 1) % 7) / 10 AS confidence, array_to_string(list_sort(list_distinct(['k' || turn % 3, 'k' || (turn + 1) % 3, 'base'])), ',') AS sources,
    length({norm_sql('r')}) > length({norm_sql('l')}) OR turn % 3 <> (turn + 1) % 3 AS novel FROM p""",
)
def merge_near_duplicates(t: Tables):
    l = t.conversations.select("conv_id", "turn", F.col("text").alias("l"))
    r = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("r"))
    p = l.join(r, ["conv_id", "turn"])
    mine = F.array(F.concat(F.lit("k"), F.col("turn") % 3), F.lit("base"))
    other = F.array(F.concat(F.lit("k"), (F.col("turn") + 1) % 3), F.lit("base"))
    fact = E.longer_text(F.col("l"), F.col("r"))
    return p.withColumn("fact", fact).select(
        "conv_id",
        "turn",
        F.md5("fact").alias("fact_md5"),
        F.greatest(F.col("turn") % 7 / 10, (F.col("turn") + 1) % 7 / 10).alias("confidence"),
        F.array_join(F.array_sort(F.array_union(mine, other)), ",").alias("sources"),
        ((F.col("fact") != F.col("l")) | (F.size(F.array_except(other, mine)) > 0)).alias("novel"),
    )


@query(
    "proposal_identity",
    f"""WITH {RECORDS_SQL} SELECT record_id, CASE record_id % 4 WHEN 0 THEN 'effect:' || topic_id || ':' || {norm_sql('title')}
      WHEN 1 THEN 'realization:' || topic_id || ':' || {norm_sql('title')} WHEN 2 THEN 'interaction:' || title
      ELSE 'dossier:' || topic_id || ':dissent:' || {norm_sql('title')} END AS identity FROM records""",
)
def proposal_identity(t: Tables):
    kind = F.get(X.literals(["effect", "realization", "interaction", "dossier_section"]), (F.col("record_id") % 4).cast("int"))
    identity = E.proposal_identity(kind, F.col("topic_id"), F.col("title"), F.lit("dissent"))
    return records(t).select("record_id", identity.alias("identity"))


@query(
    "first_per_quarter",
    """SELECT o_custkey AS domain, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter,
    min(o_orderdate) AS captured, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS capture_id FROM orders GROUP BY 1, 2""",
)
def first_per_quarter(t: Tables):
    rows = t.orders.select(F.col("o_custkey").alias("domain"), F.col("o_orderdate").alias("captured"), F.col("o_orderkey").alias("capture_id"))
    return E.first_per_quarter(rows, "domain", "captured", "capture_id")


# --- joins and set operations ------------------------------------------------------------
@query(
    "lookup_join",
    """SELECT l_orderkey, l_linenumber, l_partkey, p_brand, s_nationkey FROM lineitem
    JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey""",
)
def lookup_join(t: Tables):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    supplier = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    joined = skew_join(lines, part, "l_partkey")
    return joined.join(supplier, "l_suppkey").drop("l_suppkey")


@query(
    "unresolved_references",
    "SELECT DISTINCT o_custkey AS topic_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
)
def unresolved_references(t: Tables):
    refs = t.orders.select(F.col("o_custkey").alias("topic_id")).distinct()
    known = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("topic_id"))
    return R.unresolved(refs, known, "topic_id")


@query("semi_join", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join(t: Tables):
    return t.documents.select("doc_id", "lang").join(t.labels.filter("quality = 1"), "doc_id", "left_semi")


@query("anti_join", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join(t: Tables):
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left_anti")


_HALVES = f"{KEYED_SQL.strip()}, cur AS (SELECT * FROM keyed WHERE query_index >= 10), prev AS (SELECT * FROM keyed WHERE query_index < 10)"
MATCH_SQL = """(doi IN (SELECT doi FROM prev WHERE doi IS NOT NULL) OR openalex_id IN (SELECT openalex_id FROM prev WHERE openalex_id IS NOT NULL)
  OR title_key IN (SELECT title_key FROM prev WHERE title_key IS NOT NULL))"""


def halves(t: Tables):
    r = keyed_records(t)
    return r.filter("query_index >= 10"), r.filter("query_index < 10")


@query("match_any_key", f"WITH {_HALVES} SELECT record_id FROM cur WHERE {MATCH_SQL}")
def match_any_key(t: Tables):
    current, previous = halves(t)
    return E.match_any_key(current, previous, "record_id", ["doi", "openalex_id", "title_key"])


@query(
    "latest_run_per_source",
    """SELECT user_id AS source_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS last_run FROM events GROUP BY user_id""",
)
def latest_run_per_source(t: Tables):
    from corroborate.operators.skew import latest_per_key

    runs = t.events.select(F.col("user_id").alias("source_id"), F.col("event_type").alias("status"), F.col("ts").alias("last_run"), "event_id")
    return latest_per_key(runs, ["source_id"], ["last_run", "event_id"]).drop("event_id")


@query(
    "overlay_artifacts",
    """WITH a AS (SELECT o_custkey AS id, 1 AS p, o_orderkey AS seq, 'artifact' AS origin FROM orders WHERE o_orderstatus = 'F'
      UNION ALL SELECT o_custkey, 0, o_orderkey, 'proposal' FROM orders WHERE o_orderstatus <> 'F')
    SELECT id, arg_max(origin, (p, seq)) AS origin, arg_max(seq, (p, seq)) AS seq FROM a GROUP BY id""",
)
def overlay_artifacts(t: Tables):
    base = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), "o_orderstatus")
    done = base.filter("o_orderstatus = 'F'").select("id", "seq", F.lit("artifact").alias("origin"))
    live = base.filter("o_orderstatus <> 'F'").select("id", "seq", F.lit("proposal").alias("origin"))
    return R.overlay(done, live, "id", "seq")


@query(
    "upsert_latest",
    """WITH b AS (SELECT user_id, event_type, event_id, value, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 1 ELSE 0 END AS batch FROM events)
    SELECT user_id, event_type, arg_max(value, (batch, event_id)) AS value, arg_max(event_id, (batch, event_id)) AS event_id FROM b GROUP BY 1, 2""",
)
def upsert_latest(t: Tables):
    rows = t.events.select("user_id", "event_type", "value", "event_id", "ts")
    split = F.to_timestamp(F.lit("2024-01-20"))
    history, batch = rows.filter(F.col("ts") < split).drop("ts"), rows.filter(F.col("ts") >= split).drop("ts")
    return R.upsert_latest(history, batch, ["user_id", "event_type"], "event_id")


_TERMINAL_SQL = "SELECT DISTINCT 'T' || (user_id % 9) AS topic_id, event_type AS mode, user_id AS record_id FROM events"


@query("terminal_union", f"SELECT topic_id, mode, count(*) AS records FROM ({_TERMINAL_SQL}) GROUP BY 1, 2")
def terminal_union(t: Tables):
    rows = t.events.select(
        F.concat(F.lit("T"), F.col("user_id") % 9).alias("topic_id"),
        F.lit("evidence").alias("kind"),
        F.col("event_type").alias("mode"),
        F.lit("").alias("effect_id"),
        F.col("user_id").alias("record_id"),
        "ts",
    )
    split = F.to_timestamp(F.lit("2024-01-15"))
    union = R.terminal_union(rows.filter(F.col("ts") < split), rows.filter(F.col("ts") >= split))
    return union.groupBy("topic_id", "mode").agg(F.count(F.lit(1)).alias("records"))


@query(
    "pending_except",
    "SELECT doc_id AS record_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE toxic = 0",
)
def pending_except(t: Tables):
    eligible = t.documents.select(F.col("doc_id").alias("record_id"))
    done = t.labels.filter("toxic = 0").select(F.col("doc_id").alias("record_id"))
    return eligible.exceptAll(done).distinct()


@query(
    "contradictory_states",
    """SELECT user_id AS record_id, event_type AS mode FROM events WHERE value < 20 INTERSECT SELECT user_id, event_type FROM events WHERE value >= 20""",
)
def contradictory_states(t: Tables):
    coverage = t.events.select(
        F.lit("T").alias("topic_id"),
        F.lit("evidence").alias("kind"),
        F.col("event_type").alias("mode"),
        F.col("user_id").alias("record_id"),
        F.when(F.col("value") < 20, "processed").otherwise("skipped_irrelevant").alias("state"),
    )
    return R.contradictory_states(coverage).select("record_id", "mode")


@query(
    "union_batches",
    f"""WITH RECURSIVE {MERGED_SQL} SELECT topic_id, count(*) AS records, CAST(sum(cluster_size) AS BIGINT) AS rows FROM merged GROUP BY topic_id""",
)
def union_batches(t: Tables):
    current, previous = halves(t)
    both = previous.unionByName(current)
    one = E.merge_cluster(
        E.resolve_entities(both, "record_id", ["doi", "openalex_id", "title_key"]), ["cluster"], "record_id"
    )
    return one.groupBy("topic_id").agg(F.count(F.lit(1)).alias("records"), F.sum("cluster_size").alias("rows"))


@query(
    "set_equality",
    """SELECT coalesce(a.l_suppkey, b.s_suppkey) AS s_suppkey, CASE WHEN a.l_suppkey IS NULL THEN 'declared_absent' ELSE 'present_undeclared' END AS violation
    FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-03-01') a
    FULL JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) b ON a.l_suppkey = b.s_suppkey WHERE a.l_suppkey IS NULL OR b.s_suppkey IS NULL""",
)
def set_equality(t: Tables):
    from corroborate.operators.constraints import set_difference

    declared = t.supplier.filter("s_acctbal > 0").select("s_suppkey")
    present = t.lineitem.filter(F.col("l_shipdate") < F.to_timestamp(F.lit("1995-03-01"))).select(F.col("l_suppkey").alias("s_suppkey"))
    return set_difference(declared, present, "s_suppkey")
