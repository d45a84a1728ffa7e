"""Grounding audits, role checks, similarity, review flags, tagging, relevance."""

from __future__ import annotations

from pyspark.sql import functions as F

from corroborate.functions import text as X
from corroborate.functions import vocabulary as V
from corroborate.operators import classify as C
from corroborate.operators import grounding as G
from corroborate.operators import similarity as Y
from corroborate.plans.entity import FOUNDATIONAL_SQL, REVIEW_SQL
from corroborate.plans.registry import Tables, query
from corroborate.plans.views import NOW_YEAR, RECORDS_SQL, norm_sql, records

# Two citations per item; every eleventh kind is broken in its own way.
CITATION_SQL = f"""
{RECORDS_SQL.strip()},
src AS (SELECT doc_id AS record_id, lang AS r_topic_id, text AS source_text, n_chars,
  CASE WHEN position(chr(10) IN text) > 0 THEN substr(text, 1, position(chr(10) IN text) - 1) ELSE text END AS r_title,
  CASE WHEN doc_id % 13 <> 0 THEN '10.5555/' || doc_id END AS r_doi, doc_id % 11 AS k,
  (doc_id * 37) % greatest(n_chars - 40, 1) AS s FROM documents),
cit AS (SELECT CAST(floor(record_id / 2) AS BIGINT) AS item_id, record_id % 2 AS pos, k,
  CASE WHEN k = 4 THEN record_id + 1000000000 ELSE record_id END AS record_id,
  CASE WHEN k = 9 THEN '  ' WHEN k = 3 THEN substr(source_text, s + 1, 40) || ' zqx' ELSE substr(source_text, s + 1, 40) END AS quote,
  CASE WHEN k = 5 THEN NULL WHEN k = 6 THEN 'background' ELSE 'finding' END AS span_role,
  CASE WHEN k NOT IN (3, 9) THEN s END AS span_start,
  CASE WHEN k = 2 THEN n_chars + 999 WHEN k NOT IN (3, 9) THEN least(s + 40, n_chars) END AS span_end,
  CASE WHEN k = 7 THEN '10.5555/other' ELSE '10.5555/' || record_id END AS doi,
  CASE WHEN k = 8 THEN 'other' ELSE r_title END AS title,
  CASE WHEN k = 10 THEN 'xx' ELSE r_topic_id END AS topic_id,
  CASE WHEN k = 1 THEN sha256('old') ELSE sha256(source_text) END AS source_sha256 FROM src)
"""


def sources(t: Tables):
    at = F.instr("text", "\n")
    return t.documents.select(
        F.col("doc_id").alias("record_id"),
        F.col("text").alias("source_text"),
        F.col("lang").alias("r_topic_id"),
        F.when(at > 0, F.substring("text", F.lit(1), at - 1)).otherwise(F.col("text")).alias("r_title"),
        F.when(F.col("doc_id") % 13 != 0, F.concat(F.lit("10.5555/"), "doc_id")).alias("r_doi"),
    )


def citations(t: Tables):
    src = sources(t).join(t.documents.select(F.col("doc_id").alias("record_id"), "n_chars"), "record_id")
    k = F.col("record_id") % 11
    s = (F.col("record_id") * 37) % F.greatest(F.col("n_chars") - 40, F.lit(1))
    piece = F.substring("source_text", (s + 1).cast("int"), F.lit(40))
    spanned = ~k.isin(3, 9)
    return src.select(
        F.floor(F.col("record_id") / 2).alias("item_id"),
        (F.col("record_id") % 2).alias("pos"),
        k.alias("k"),
        F.when(k == 4, F.col("record_id") + 1000000000).otherwise(F.col("record_id")).alias("record_id"),
        F.when(k == 9, "  ").when(k == 3, F.concat(piece, F.lit(" zqx"))).otherwise(piece).alias("quote"),
        F.when(k == 6, "background").when(k != 5, "finding").alias("span_role"),
        F.when(spanned, s).alias("start"),
        F.when(k == 2, F.col("n_chars") + 999).when(spanned, F.least(s + 40, "n_chars")).alias("end"),
        F.when(k == 7, "10.5555/other").otherwise(F.concat(F.lit("10.5555/"), "record_id")).alias("doi"),
        F.when(k == 8, "other").otherwise(F.col("r_title")).alias("title"),
        F.when(k == 10, "xx").otherwise(F.col("r_topic_id")).alias("topic_id"),
        F.when(k == 1, F.sha2(F.lit("old"), 256)).otherwise(F.sha2("source_text", 256)).alias("source_sha256"),
    )


@query(
    "ground_quotes",
    f"""WITH {CITATION_SQL}, j AS (SELECT cit.*, source_text, {norm_sql('quote')} AS needle,
      regexp_extract(lower(source_text), replace({norm_sql('quote')}, ' ', '[^a-z0-9]+')) AS hit FROM cit LEFT JOIN src USING (record_id)),
    p AS (SELECT *, needle <> '' AND contains({norm_sql("coalesce(source_text, '')")}, needle) AS inside FROM j)
    SELECT item_id, pos, CASE WHEN inside THEN position(hit IN lower(source_text)) - 1 END AS found_start,
      CASE WHEN inside THEN position(hit IN lower(source_text)) - 1 + length(hit) END AS found_end,
      CASE WHEN inside THEN substr(source_text, position(hit IN lower(source_text)), length(hit)) END AS derived FROM p""",
)
def ground_quotes(t: Tables):
    quotes = citations(t).select("item_id", "pos", "record_id", "quote")
    keyed = quotes.withColumn("cid", F.concat_ws(":", "item_id", "pos"))
    out = G.ground_quotes(keyed, sources(t).select("record_id", "source_text"), "cid")
    return out.select("item_id", "pos", F.col("start").alias("found_start"), F.col("end").alias("found_end"), "derived")


@query(
    "derive_quote",
    f"""WITH {CITATION_SQL} SELECT item_id, pos, CASE WHEN span_start >= 0 AND span_end > span_start AND span_end <= length(source_text)
      AND trim(substr(source_text, span_start + 1, span_end - span_start), ' ' || chr(10)) <> '' THEN substr(source_text, span_start + 1, span_end - span_start) END AS derived
    FROM cit JOIN src USING (record_id)""",
)
def derive_quote(t: Tables):
    joined = citations(t).join(sources(t).select("record_id", "source_text"), "record_id")
    return joined.select("item_id", "pos", G.derive_quote(F.col("source_text"), F.col("start"), F.col("end")).alias("derived"))


@query(
    "span_audit",
    f"""WITH {CITATION_SQL}, a AS (SELECT item_id, pos, source_text, span_start, span_end, quote, source_sha256,
      span_start >= 0 AND span_end > span_start AND span_end <= length(source_text) AS fits FROM cit LEFT JOIN src USING (record_id))
    SELECT item_id, pos, CASE WHEN source_text IS NULL THEN 'unknown_record' WHEN span_start IS NULL THEN '' ELSE
      array_to_string(list_filter([CASE WHEN sha256(source_text) <> source_sha256 THEN 'span_stale' END,
        CASE WHEN NOT fits THEN 'span_out_of_range' END,
        CASE WHEN fits AND substr(source_text, span_start + 1, span_end - span_start) <> quote THEN 'span_does_not_reslice' END], lambda x: x IS NOT NULL), ',') END AS conditions FROM a""",
)
def span_audit(t: Tables):
    keyed = citations(t).withColumn("cid", F.concat_ws(":", "item_id", "pos"))
    out = G.span_audit(keyed, sources(t).select("record_id", "source_text"), "cid")
    return out.select("item_id", "pos", F.array_join("conditions", ",").alias("conditions"))


@query(
    "source_context",
    f"""WITH {CITATION_SQL} SELECT item_id, pos, CASE WHEN span_end > n_chars THEN 'span_out_of_range' WHEN k = 1 THEN 'span_stale' END AS condition,
      CASE WHEN span_end <= n_chars AND k <> 1 THEN substr(source_text, greatest(span_start - 60, 0) + 1, span_start - greatest(span_start - 60, 0)) END AS before,
      CASE WHEN span_end <= n_chars AND k <> 1 THEN substr(source_text, span_end + 1, least(span_end + 60, n_chars) - span_end) END AS after
    FROM (SELECT item_id, pos, span_start, span_end, record_id FROM cit WHERE k NOT IN (3, 4, 9)) c JOIN src USING (record_id)""",
)
def source_context(t: Tables):
    keyed = citations(t).filter(~F.col("k").isin(3, 4, 9)).withColumn("cid", F.concat_ws(":", "item_id", "pos"))
    out = G.source_context(keyed, sources(t).select("record_id", "source_text"), "cid", 60)
    return out.select("item_id", "pos", "condition", "before", "after")


_GATE_SQL = f"""
{CITATION_SQL.strip()},
items AS (SELECT DISTINCT item_id FROM cit UNION ALL SELECT DISTINCT 1000000 + conv_id FROM conversations),
g AS (SELECT c.*, source_text, r_doi, r_title, r_topic_id, {norm_sql('quote')} AS needle FROM cit c LEFT JOIN src USING (record_id)),
v AS (SELECT item_id, pos, span_role, CASE WHEN trim(quote, ' ' || chr(10)) = '' THEN 'malformed_citation' WHEN source_text IS NULL THEN 'unknown_record_id'
    WHEN NOT contains({norm_sql('source_text')}, needle) THEN 'quote_not_in_source' WHEN span_role IS NULL THEN 'span_role_missing' END AS a,
  CASE WHEN topic_id IS DISTINCT FROM r_topic_id THEN 'provenance_mismatch' WHEN r_doi IS NULL OR doi IS DISTINCT FROM r_doi THEN 'doi_unresolved'
    WHEN title IS DISTINCT FROM r_title THEN 'title_mismatch' WHEN needle = '' THEN 'quote_not_in_source'
    WHEN span_end <= length(source_text) AND sha256(source_text) <> source_sha256 THEN 'provenance_mismatch' END AS b FROM g),
f AS (SELECT item_id, arg_min(a, pos) FILTER (WHERE a IS NOT NULL) AS a, arg_min(b, pos) FILTER (WHERE b IS NOT NULL) AS b,
  bool_or(coalesce(span_role = 'finding', FALSE)) AS found FROM v GROUP BY item_id),
gate AS (SELECT item_id, CASE WHEN f.found IS NULL THEN 'no_citations' WHEN a IS NOT NULL THEN a WHEN NOT found THEN 'span_role_not_finding' ELSE b END AS reason FROM items LEFT JOIN f USING (item_id))
"""


def gate_inputs(t: Tables):
    c = citations(t)
    extra = t.conversations.select((F.lit(1000000) + F.col("conv_id")).alias("item_id")).distinct()
    items = c.select("item_id").distinct().unionByName(extra)
    return items, c, sources(t)


@query("grounding_gate", f"WITH {_GATE_SQL} SELECT item_id, reason FROM gate")
def grounding_gate(t: Tables):
    return G.grounding_gate(*gate_inputs(t)).select("item_id", "reason")


@query(
    "gate_reason_counts",
    f"WITH {_GATE_SQL} SELECT coalesce(reason, 'admitted') AS reason, count(*) AS items FROM gate GROUP BY 1",
)
def gate_reason_counts(t: Tables):
    gate = G.grounding_gate(*gate_inputs(t))
    return gate.groupBy(F.coalesce("reason", F.lit("admitted")).alias("reason")).agg(F.count(F.lit(1)).alias("items"))


@query(
    "grounding_errors",
    f"""WITH {CITATION_SQL}, e AS (SELECT c.*, source_text, r_doi, r_title, r_topic_id, {norm_sql('quote')} AS needle FROM cit c LEFT JOIN src USING (record_id)),
    l AS (SELECT item_id, pos, unnest([CASE WHEN source_text IS NULL THEN 'missing_record' END,
      CASE WHEN source_text IS NOT NULL AND topic_id <> r_topic_id THEN 'topic_mismatch' END,
      CASE WHEN source_text IS NOT NULL AND (r_doi IS NULL OR doi <> r_doi) THEN 'doi_unresolved' END,
      CASE WHEN source_text IS NOT NULL AND title <> r_title THEN 'title_mismatch' END,
      CASE WHEN source_text IS NOT NULL AND (needle = '' OR NOT contains({norm_sql('source_text')}, needle)) THEN 'quote_unresolved' END,
      CASE WHEN span_start IS NOT NULL AND sha256(source_text) <> source_sha256 THEN 'span_stale' END,
      CASE WHEN span_start IS NOT NULL AND span_end > length(source_text) THEN 'span_out_of_range' END]) AS error FROM e)
    SELECT error, count(*) AS citations FROM l WHERE error IS NOT NULL GROUP BY error""",
)
def grounding_errors(t: Tables):
    c = citations(t).withColumn("cid", F.concat_ws(":", "item_id", "pos"))
    c = c.withColumn("corpus_kind", F.lit("evidence")).withColumn("source_id", F.lit("s"))
    src = sources(t).withColumn("r_source_id", F.lit("s"))
    errors = G.grounding_errors(c, src, "cid")
    return errors.groupBy("error").agg(F.count(F.lit(1)).alias("citations"))


@query(
    "inference_errors",
    """WITH i AS (SELECT conv_id, turn, conv_id % 100 AS effect_id, CASE WHEN turn % 2 = 0 THEN role ELSE 'other ' || role END AS quote,
      turn % 4 AS record_id, CASE WHEN turn = 3 THEN 'x' ELSE 'T' END AS topic_id FROM conversations),
    e AS (SELECT effect_id, 'user' AS fact, 'assistant' AS boundary FROM (SELECT DISTINCT conv_id % 100 AS effect_id FROM conversations) WHERE effect_id < 80),
    l AS (SELECT unnest([CASE WHEN fact IS NULL THEN 'missing_effect' END, CASE WHEN fact IS NOT NULL AND topic_id <> 'T' THEN 'topic_mismatch' END,
      CASE WHEN fact IS NOT NULL AND quote NOT IN (fact, boundary) THEN 'not_own_statement' END,
      CASE WHEN fact IS NOT NULL AND record_id = 2 THEN 'record_not_cited' END]) AS error FROM i LEFT JOIN e USING (effect_id))
    SELECT error, count(*) AS inferences FROM l WHERE error IS NOT NULL GROUP BY error""",
)
def inference_errors(t: Tables):
    c = t.conversations
    turn = F.col("turn")
    items = c.select(
        F.concat_ws(":", "conv_id", "turn").alias("cid"),
        (F.col("conv_id") % 100).alias("effect_id"),
        F.when(turn % 2 == 0, F.col("role")).otherwise(F.concat(F.lit("other "), "role")).alias("quote"),
        (turn % 4).alias("record_id"),
        F.when(turn == 3, "x").otherwise("T").alias("topic_id"),
    )
    effects = (
        c.select((F.col("conv_id") % 100).alias("effect_id")).distinct().filter("effect_id < 80")
        .select("effect_id", F.lit("user").alias("e_fact"), F.lit("assistant").alias("e_boundary"), F.lit("T").alias("e_topic_id"))
    )
    cited = effects.select("effect_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(3)).cast("array<bigint>")).alias("record_id"))
    errors = G.inference_errors(items, effects, cited, "cid")
    return errors.groupBy("error").agg(F.count(F.lit(1)).alias("inferences"))


_TURNS = """turns AS (SELECT a.conv_id, a.turn, a.text AS quote, b.text AS fact FROM conversations a
  JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def turns(t: Tables):
    a = t.conversations.select("conv_id", "turn", F.col("text").alias("quote"))
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("fact"))
    return a.join(b, ["conv_id", "turn"]).withColumn("item_id", F.concat_ws(":", "conv_id", "turn"))


@query(
    "sections",
    f"""WITH {_TURNS} SELECT conv_id, turn, 'Background@0;Results@' || (13 + length(quote)) AS sections,
    CASE WHEN 20 >= 13 + length(quote) THEN 'Results' ELSE 'Background' END AS at_20,
    CASE WHEN 20 >= 13 + length(quote) THEN 'finding,limitation,background' ELSE 'background,hypothesis' END AS allowed FROM turns""",
)
def sections(t: Tables):
    text = F.concat(F.lit("Background: "), "quote", F.lit(" Results: "), "fact")
    found = turns(t).withColumn("found", G.sections(text)).withColumn("at", G.section_at(F.col("found"), F.lit(20)))
    listed = F.transform("found", lambda s: F.concat_ws("@", s["label"], s["at"].cast("string")))
    return found.select(
        "conv_id",
        "turn",
        F.array_join(listed, ";").alias("sections"),
        F.col("at.label").alias("at_20"),
        F.array_join("at.allowed", ",").alias("allowed"),
    )


_STOP = "(" + ", ".join(f"'{w}'" for w in V.OVERLAP_STOPWORDS) + ")"


def content_words_sql(text: str) -> str:
    raw = f"list_filter(string_split_regex(lower({text}), '[^a-z\\x{{C0}}-\\x{{24F}}]+'), lambda x: length(x) >= 4 AND x NOT IN {_STOP})"
    one = f"list_transform({raw}, lambda x: CASE WHEN ends_with(x, 's') AND NOT ends_with(x, 'ss') THEN substr(x, 1, length(x) - 1) ELSE x END)"
    return f"list_distinct(list_filter({one}, lambda x: length(x) >= 4 AND x NOT IN {_STOP}))"


@query(
    "contradiction",
    f"""WITH {_TURNS}, f AS (SELECT *, CASE WHEN regexp_matches(quote, '[.!?](\\s|$)') THEN regexp_extract(quote, '(?s)^(.*?[.!?])(\\s|$)', 1) ELSE quote END AS first FROM turns)
    SELECT conv_id, turn, len({content_words_sql('first')}) >= 3 AS reversed,
      CASE WHEN len({content_words_sql('first')}) >= 3 THEN 'contrary-to' END AS marker FROM f""",
)
def contradiction(t: Tables):
    q = F.col("quote")
    head = F.regexp_extract(q, r"(?s)^(.*?[.!?])(\s|$)", 1)
    first = F.when(head != "", head).otherwise(q)
    base = turns(t).withColumn("first", first)
    source = F.concat("quote", F.lit(" Contrary to that, "), F.lower("first"))
    found = base.select(
        "conv_id", "turn", G.contradiction(source, F.length("first"), F.col("first")).alias("c")
    )
    return found.select("conv_id", "turn", F.col("c").isNotNull().alias("reversed"), F.col("c.marker").alias("marker"))


@query(
    "role_verdict",
    f"""WITH {_TURNS}, f AS (SELECT *, conv_id % 3 AS k FROM turns)
    SELECT conv_id, turn, CASE WHEN k = 0 THEN 'span_role_missing' WHEN k = 1 THEN 'span_role_contradicted_by_structure'
      WHEN len({content_words_sql('fact')}) >= 3 THEN 'premise_contradicted_downstream' END AS verdict FROM f""",
)
def role_verdict(t: Tables):
    k = F.col("conv_id") % 3
    clean = F.translate("fact", ".!?", "   ")
    label = F.when(k == 1, "Methods: ").otherwise("Results: ")
    source = F.concat(label, clean, F.lit(". However. Contrary to "), clean, F.lit(". Conclusion: none."))
    role = F.when(k == 0, "opinion").otherwise("finding")
    end = F.lit(9) + F.length("fact")
    return turns(t).select(
        "conv_id", "turn", G.role_verdict(role, source, F.lit(9), end).alias("verdict")
    )


# --- similarity ------------------------------------------------------------------------
_TOKENS_SQL = f"""
toks AS (SELECT doc_id, lang AS block, list_sort(list_distinct(list_filter(string_split({norm_sql('text')}, ' '), lambda w: length(w) > 1))) AS tokens FROM documents),
sets AS (SELECT block, tokens, min(doc_id) AS id, count(*) AS copies FROM toks WHERE len(tokens) > 0 GROUP BY block, tokens),
e AS (SELECT block, id, len(tokens) AS n, unnest(tokens) AS token FROM sets),
inter AS (SELECT a.block, a.id AS a_id, b.id AS b_id, a.n AS an, b.n AS bn, count(*) AS i FROM e a JOIN e b ON a.block = b.block AND a.token = b.token AND a.id < b.id GROUP BY ALL),
scored AS (SELECT *, greatest(i / (an + bn - i), i / least(an, bn) * CAST(0.9 AS DOUBLE)) AS score FROM inter)
"""


def token_table(t: Tables):
    return t.documents.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("block"), X.quality_tokens(F.col("text")).alias("tokens")
    )


@query(
    "similar_pairs",
    f"""WITH {_TOKENS_SQL} SELECT s.block, a_id, b_id, a.copies AS a_copies, b.copies AS b_copies, floor(score * 10000 + 0.5) / 10000 AS score
    FROM scored s JOIN sets a ON a.id = a_id AND a.block = s.block JOIN sets b ON b.id = b_id AND b.block = s.block WHERE score >= 0.78""",
)
def similar_pairs(t: Tables):
    return Y.similar_pairs(token_table(t)).withColumn("score", F.floor(F.col("score") * 10000 + 0.5) / 10000)


@query(
    "best_duplicate",
    f"""WITH toks AS (SELECT doc_id AS id, lang AS block, list_distinct(list_filter(string_split({norm_sql('text')}, ' '), lambda w: length(w) > 1)) AS tokens FROM documents),
    e AS (SELECT id, block, len(tokens) AS n, unnest(tokens) AS token FROM toks),
    inter AS (SELECT a.id AS candidate_id, b.id AS match_id, a.n AS an, b.n AS bn, count(*) AS i FROM e a JOIN e b ON a.block = b.block AND a.token = b.token WHERE a.id % 2 = 1 AND b.id % 2 = 0 GROUP BY ALL),
    s AS (SELECT candidate_id, match_id, greatest(i / (an + bn - i), i / least(an, bn) * CAST(0.9 AS DOUBLE)) AS score FROM inter),
    r AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, match_id) AS rn FROM s WHERE score >= 0.78)
    SELECT candidate_id, match_id, floor(score * 10000 + 0.5) / 10000 AS score FROM r WHERE rn = 1""",
)
def best_duplicate(t: Tables):
    tokens = token_table(t)
    best = Y.best_duplicate(tokens.filter("id % 2 = 1"), tokens.filter("id % 2 = 0"))
    return best.withColumn("score", F.floor(F.col("score") * 10000 + 0.5) / 10000)


CLAUSE_SPLIT = r"(?i),\s*(?:but|and|yet)\s+|;\s*|([.!?])\s+"


def clauses_sql(text: str) -> str:
    split = f"string_split(regexp_replace({text}, '{CLAUSE_SPLIT}', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({split}, lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '')"


def tokens_sql(text: str) -> str:
    return f"list_distinct(list_filter(string_split({norm_sql(text)}, ' '), lambda w: length(w) > 1))"


@query(
    "overreach",
    f"""WITH {_TURNS}, c AS (SELECT conv_id, turn, quote, unnest({clauses_sql('fact')}) AS clause, generate_subscripts({clauses_sql('fact')}, 1) - 1 AS clause_no FROM turns),
    s AS (SELECT *, {tokens_sql('clause')} AS ct, {tokens_sql('quote')} AS qt FROM c),
    r AS (SELECT conv_id, turn, clause_no, clause, len(list_intersect(ct, qt)) / len(ct) AS support FROM s WHERE len(ct) > 0)
    SELECT conv_id || ':' || turn AS item_id, CAST(clause_no AS INTEGER) AS clause_no, clause, floor(support * 10000 + 0.5) / 10000 AS support FROM r WHERE support < 0.5""",
)
def overreach(t: Tables):
    base = turns(t)
    out = Y.overreach(base.select("item_id", "fact"), base.select("item_id", "quote"))
    return out.withColumn("support", F.floor(F.col("support") * 10000 + 0.5) / 10000)


# Concept groups over frequent words of the driver's data.
GROUPS = {"pointer": ["that", "this", "the"], "linker": ["and", "und", "y", "et"]}
_GROUPS_SQL = "list_filter([CASE WHEN list_has_any({0}, ['that','this','the']) THEN 'pointer' END, CASE WHEN list_has_any({0}, ['and','und','y','et']) THEN 'linker' END], lambda g: g IS NOT NULL)"


def _sim_sql(a: str, b: str, ga: str, gb: str) -> str:
    i = f"len(list_intersect({a}, {b}))"
    raw = f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE greatest({i} / (len({a}) + len({b}) - {i}), {i} / least(len({a}), len({b})) * CAST(0.9 AS DOUBLE)) END"
    grp = f"CASE WHEN len({ga}) = 0 OR len({gb}) = 0 THEN 0 ELSE len(list_intersect({ga}, {gb})) / least(len({ga}), len({gb})) END"
    return f"greatest({raw}, 0.8 * ({grp}))"


@query(
    "structural_duplicate",
    f"""WITH {RECORDS_SQL}, d AS (SELECT record_id AS id, topic_id, query_index, title AS action_text, ' when ' || source || ' ' || topic_id AS trigger_text FROM records),
    p AS (SELECT id, topic_id, query_index, {tokens_sql('action_text')} AS a, {tokens_sql('trigger_text')} AS t FROM d),
    g AS (SELECT *, {_GROUPS_SQL.format('a')} AS ag, {_GROUPS_SQL.format('t')} AS tg FROM p),
    s AS (SELECT n.id AS candidate_id, o.id AS match_id, {_sim_sql('n.a', 'o.a', 'n.ag', 'o.ag')} AS action_score, {_sim_sql('n.t', 'o.t', 'n.tg', 'o.tg')} AS trigger_score
      FROM g n JOIN g o ON n.topic_id = o.topic_id AND n.id <> o.id WHERE n.query_index < 12 AND o.query_index >= 8),
    r AS (SELECT *, least(action_score, trigger_score) AS score FROM s),
    k AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, match_id) AS rn FROM r WHERE score >= 0.3)
    SELECT candidate_id, match_id, floor(score * 10000 + 0.5) / 10000 AS score FROM k WHERE rn = 1""",
)
def structural_duplicate(t: Tables):

    d = records(t).select(
        F.col("record_id").alias("id"),
        "topic_id",
        "query_index",
        F.concat(F.col("title"), F.lit(" when "), "source", F.lit(" "), "topic_id").alias("directive"),
    )
    out = Y.structural_duplicate(d.filter("query_index < 12"), d.filter("query_index >= 8"), groups=GROUPS)
    return out.select("candidate_id", "match_id", (F.floor(F.col("score") * 10000 + 0.5) / 10000).alias("score"))


@query(
    "weak_anchor",
    f"""WITH {_TURNS}, c AS (SELECT conv_id, turn, {tokens_sql('quote')} AS pt, list_transform({clauses_sql('fact')}, lambda c: {tokens_sql('c')}) AS ct, {tokens_sql('fact')} AS ft FROM turns),
    g AS (SELECT *, {_GROUPS_SQL.format('pt')} AS pg, {_GROUPS_SQL.format('ft')} AS fg,
      coalesce(list_max(list_transform(ct, lambda c: CASE WHEN len(pt) = 0 THEN 1 ELSE len(list_intersect(pt, c)) / len(pt) END)), 0) AS best FROM c)
    SELECT conv_id || ':' || turn AS item_id, floor(best * 10000 + 0.5) / 10000 AS best_score FROM g WHERE best < 0.12 AND NOT list_has_any(pg, fg) AND len(pg) > 0""",
)
def weak_anchor(t: Tables):
    base = turns(t)
    out = Y.weak_anchor(
        base.select("item_id", F.col("quote").alias("pattern")),
        base.select("item_id", F.col("item_id").alias("effect_id")),
        base.select(F.col("item_id").alias("effect_id"), "fact"),
        groups=GROUPS,
    )
    return out.select("item_id", (F.floor(F.col("best_score") * 10000 + 0.5) / 10000).alias("best_score"))


# --- tagging ------------------------------------------------------------------------------
# Markers over words of the driver's data, in the form of the published vocabularies.
DATA_MARKERS = [("that-the", r"\bthat the\b"), ("nicht", r"\bnicht\b"), ("la-de", r"\bla\s+de\b"), ("with", r"\bwith\s+\w+\b"), ("onn", r"\bonn")]
OLD_MARKERS = [("that-the", r"\bthat the\b"), ("and", r"\band\b")]
_PROBE = "title || ' ' || coalesce(abstract, '')"


def fires_sql(text: str, markers) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches({text}, '(?i){p}') THEN '{n}' END" for n, p in markers)
    return f"list_filter([{cases}], lambda m: m IS NOT NULL)"


@query(
    "dissent_markers",
    f"WITH {RECORDS_SQL} SELECT record_id, array_to_string({fires_sql(_PROBE, DATA_MARKERS)}, ',') AS markers FROM records",
)
def dissent_markers(t: Tables):
    text = F.concat("title", F.lit(" "), F.coalesce("abstract", F.lit("")))
    return records(t).select("record_id", F.array_join(C.fired_markers(text, DATA_MARKERS), ",").alias("markers"))


_SENTENCES = ["did not replicate", "fails to generalize", "no evidence for", "critique of", "publication bias", "contrary to", "reversal of the known effect", "null findings"]
_RE2_DISSENT = [(n, p.replace("(?![-\\s]?engineer)", "").replace("'", "''")) for n, p in V.DISSENT_MARKERS]


@query(
    "dissent_vocabulary",
    f"""WITH {RECORDS_SQL}, s AS (SELECT record_id, {_PROBE} || ' ' || [{', '.join(f"'{s}'" for s in _SENTENCES)}][1 + record_id % 8] AS txt FROM records)
    SELECT record_id, array_to_string({fires_sql('txt', _RE2_DISSENT)}, ',') AS markers FROM s""",
)
def dissent_vocabulary(t: Tables):
    tail = F.get(X.literals(_SENTENCES), (F.col("record_id") % 8).cast("int"))
    text = F.concat("title", F.lit(" "), F.coalesce("abstract", F.lit("")), F.lit(" "), tail)
    return records(t).select("record_id", F.array_join(C.fired_markers(text), ",").alias("markers"))


def classify_sql(year: int, markers) -> str:
    found = FOUNDATIONAL_SQL.replace(str(NOW_YEAR), str(year))
    any_marker = "(?i)" + "|".join(f"(?:{p})" for _, p in markers)
    return f"""list_filter([CASE WHEN {found} THEN 'foundational' END, CASE WHEN {REVIEW_SQL} THEN 'meta-analysis' END,
      CASE WHEN regexp_matches({_PROBE}, '(?i)\\breplicat') THEN 'replication' END, CASE WHEN regexp_matches({_PROBE}, '{any_marker}') THEN 'dissent' END,
      CASE WHEN year >= {year - 5} THEN 'recent' END], lambda c: c IS NOT NULL)"""


@query(
    "classify",
    f"WITH {RECORDS_SQL} SELECT record_id, array_to_string({classify_sql(NOW_YEAR, DATA_MARKERS)}, ',') AS categories FROM records",
)
def classify(t: Tables):
    return C.classify(records(t), NOW_YEAR, DATA_MARKERS).select(
        "record_id", F.array_join("categories", ",").alias("categories")
    )


@query(
    "category_counts",
    f"""WITH {RECORDS_SQL}, c AS (SELECT topic_id, {classify_sql(NOW_YEAR, DATA_MARKERS)} AS cats FROM records),
    d AS (SELECT unnest(['foundational','meta-analysis','replication','dissent','recent']) AS category)
    SELECT topic_id, category, count_if(list_contains(cats, category)) AS records FROM c, d GROUP BY 1, 2
    UNION ALL SELECT topic_id, 'none', count_if(len(cats) = 0) FROM c GROUP BY 1""",
)
def category_counts(t: Tables):
    return C.category_counts(C.classify(records(t), NOW_YEAR, DATA_MARKERS), ["topic_id"])


@query(
    "retag_diff",
    f"""WITH {RECORDS_SQL}, c AS (SELECT record_id, topic_id, {classify_sql(NOW_YEAR - 6, OLD_MARKERS)} AS old, {classify_sql(NOW_YEAR, DATA_MARKERS)} AS new FROM records)
    SELECT record_id, topic_id, array_to_string(list_filter(new, lambda x: NOT list_contains(old, x)), ',') AS gained,
    array_to_string(list_filter(old, lambda x: NOT list_contains(new, x)), ',') AS lost FROM c WHERE old <> new""",
)
def retag_diff(t: Tables):
    r = records(t)
    diff = C.retag_diff(C.classify(r, NOW_YEAR - 6, OLD_MARKERS), C.classify(r, NOW_YEAR, DATA_MARKERS))
    return diff.select(
        "record_id", "topic_id", F.array_join("gained", ",").alias("gained"), F.array_join("lost", ",").alias("lost")
    )


@query(
    "retag_summary",
    f"""WITH {RECORDS_SQL}, c AS (SELECT topic_id, {classify_sql(NOW_YEAR - 6, OLD_MARKERS)} AS old, {classify_sql(NOW_YEAR, DATA_MARKERS)} AS new FROM records)
    SELECT topic_id, count_if(list_contains(old, 'dissent')) AS dissent_before, count_if(list_contains(new, 'dissent')) AS dissent_after, count_if(old <> new) AS changed FROM c GROUP BY 1""",
)
def retag_summary(t: Tables):
    r = records(t)
    b = C.classify(r, NOW_YEAR - 6, OLD_MARKERS).select("record_id", "topic_id", F.col("categories").alias("old"))
    a = C.classify(r, NOW_YEAR, DATA_MARKERS).select("record_id", F.col("categories").alias("new"))
    return b.join(a, "record_id", "full_outer").groupBy("topic_id").agg(
        F.count_if(F.array_contains("old", "dissent")).alias("dissent_before"),
        F.count_if(F.array_contains("new", "dissent")).alias("dissent_after"),
        F.count_if(F.col("old") != F.col("new")).alias("changed"),
    )


@query(
    "marker_impact",
    f"""WITH {RECORDS_SQL}, f AS (SELECT {fires_sql(_PROBE, DATA_MARKERS)} AS fired FROM records), m AS (SELECT unnest([{', '.join(f"'{n}'" for n, _ in DATA_MARKERS)}]) AS marker)
    SELECT marker, count_if(list_contains(fired, marker)) AS hits, count_if(list_contains(fired, marker) AND len(fired) = 1) AS sole FROM f, m GROUP BY marker""",
)
def marker_impact(t: Tables):
    text = F.concat("title", F.lit(" "), F.coalesce("abstract", F.lit("")))
    return C.marker_impact(records(t), text, DATA_MARKERS)


def _coverage_sql(name: str, markers) -> str:
    pat = "(?i)" + "|".join(f"(?:{p})" for _, p in markers)
    topic = content_words_sql("quote")
    sents = "list_filter(list_transform(string_split(regexp_replace(tail, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '')"
    hit = f"len(list_filter({sents}, lambda s: regexp_matches(s, '{pat}') AND len(list_intersect({content_words_sql('s')}, topic)) >= 3)) > 0"
    return f"""SELECT '{name}' AS vocabulary, count(*) AS records, count_if(regexp_matches(tail, '{pat}')) AS reached,
      count_if(regexp_matches(tail, '{pat}') AND NOT regexp_matches(quote, '{pat}') AND {hit}) AS contradictions FROM (SELECT *, {topic} AS topic FROM q)"""


@query(
    "marker_coverage",
    f"""WITH {RECORDS_SQL}, s AS (SELECT trim(title || ' ' || coalesce(abstract, ''), ' ' || chr(10)) AS src FROM records),
    q AS (SELECT src, regexp_extract(src, '(?s)^(.*?[.!?])\\s', 1) AS quote, substr(src, length(regexp_extract(src, '(?s)^(.*?[.!?])\\s', 1)) + 1) AS tail FROM s WHERE regexp_matches(src, '[.!?]\\s'))
    {_coverage_sql('new', DATA_MARKERS)} UNION ALL {_coverage_sql('old', OLD_MARKERS)}""",
)
def marker_coverage(t: Tables):
    return C.marker_coverage(records(t), {"new": DATA_MARKERS, "old": OLD_MARKERS})


@query(
    "first_fires",
    f"WITH {RECORDS_SQL}, f AS (SELECT {fires_sql(_PROBE, DATA_MARKERS)} AS fired FROM records) SELECT fired[1] AS marker, count(*) AS first FROM f WHERE len(fired) > 0 GROUP BY 1",
)
def first_fires(t: Tables):
    text = F.concat("title", F.lit(" "), F.coalesce("abstract", F.lit("")))
    return C.first_fires(records(t), text, DATA_MARKERS)


# --- transferability ------------------------------------------------------------------------
LEXICONS = {
    "person": ["that", "nicht", "unos"],
    "artifact": ["this", "dans", "ist"],
    "institution": ["with", "para"],
    "variable": ["the", "der", "la"],
    "descriptive": ["of the"],
    "direction": ["and", "und", "et", "y"],
    "specialist": ["stupid", "avec"],
}


def _names_sql(hay: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({hay}, ' {p} ')" for p in phrases) + ")"


def _checks_sql(lex) -> str:
    n = lambda hay, key: _names_sql(hay, lex[key])
    return f"""SELECT conv_id, turn, CASE WHEN NOT {n('x', 'person')} AND NOT {n('x', 'artifact')} THEN 'fail' WHEN {n('x', 'institution')} THEN 'warn'
        WHEN {n('x', 'artifact')} THEN 'pass' ELSE 'warn' END AS subject, CASE WHEN {n('c', 'variable')} THEN 'pass' ELSE 'fail' END AS variable,
      CASE WHEN {n('c', 'descriptive')} THEN 'fail' WHEN {n('c', 'direction')} THEN 'pass' ELSE 'fail' END AS direction,
      CASE WHEN {n('x', 'specialist')} THEN 'warn' ELSE 'pass' END AS population FROM padded"""


_PADDED = f"""{_TURNS}, padded AS (SELECT conv_id, turn, ' ' || trim(regexp_replace(lower(fact || ' ' || fact), '[^a-z0-9+-]+', ' ', 'g')) || ' ' AS c,
  ' ' || trim(regexp_replace(lower(fact || ' ' || fact || ' ' || quote), '[^a-z0-9+-]+', ' ', 'g')) || ' ' AS x FROM turns)"""
_VERDICT = """CAST(len(list_filter([subject, variable, direction, population], lambda o: o = 'warn')) AS INTEGER) < 2
  AND NOT list_contains([subject, variable, direction, population], 'fail')"""


@query(
    "transferability",
    f"""WITH {_PADDED}, k AS ({_checks_sql(LEXICONS)}) SELECT conv_id, turn, subject, variable, direction, population, {_VERDICT} AS transferable,
      variable = 'pass' AS transferable_v3, array_to_string(list_filter([CASE WHEN subject <> 'pass' THEN 'subject' END, CASE WHEN direction <> 'pass' THEN 'direction' END,
      CASE WHEN population <> 'pass' THEN 'population' END], lambda m: m IS NOT NULL), ',') AS modifiers FROM k""",
)
def transferability(t: Tables):
    out = C.transferability(turns(t), "fact", "fact", "quote", LEXICONS)
    return out.select(
        "conv_id", "turn", *C.CHECKS, "transferable", "transferable_v3", F.array_join("modifiers", ",").alias("modifiers")
    )


_LATER = {**LEXICONS, "direction": ["and", "und"], "variable": ["the", "der"]}


@query(
    "verdict_drift",
    f"""WITH {_PADDED}, a AS (SELECT *, {_VERDICT} AS ok FROM ({_checks_sql(LEXICONS)})), b AS (SELECT *, {_VERDICT} AS ok FROM ({_checks_sql(_LATER)})),
    d AS (SELECT a.conv_id || ':' || a.turn AS item_id, CASE WHEN a.conv_id % 10 = 0 THEN 'ruleset' WHEN a.ok <> b.ok THEN 'verdict'
      WHEN a.variable <> b.variable OR a.direction <> b.direction THEN 'reasoning:' || array_to_string(list_filter([
        CASE WHEN a.variable <> b.variable THEN 'variable=' || b.variable END, CASE WHEN a.direction <> b.direction THEN 'direction=' || b.direction END], lambda m: m IS NOT NULL), ',') END AS drift
      FROM a JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn)
    SELECT item_id, drift FROM d WHERE drift IS NOT NULL""",
)
def verdict_drift(t: Tables):
    base = turns(t)
    ruleset = F.when(F.col("conv_id") % 10 == 0, 1).otherwise(2)
    stored = C.transferability(base, "fact", "fact", "quote", LEXICONS).withColumn("ruleset", ruleset)
    again = C.transferability(base, "fact", "fact", "quote", _LATER).withColumn("ruleset", F.lit(2))
    return C.verdict_drift(stored, again)


@query(
    "audit_v2",
    f"""WITH {_PADDED}, b AS ({_checks_sql(_LATER)}), a AS (SELECT conv_id, turn, subject, direction, population, CASE conv_id % 4 WHEN 0 THEN 'warn' WHEN 1 THEN 'fail' ELSE 'pass' END AS variable FROM ({_checks_sql(LEXICONS)})),
    d AS (SELECT a.conv_id || ':' || a.turn AS item_id, CASE WHEN a.direction <> b.direction THEN 'direction drifted to ' || b.direction WHEN a.conv_id % 4 = 0 THEN 'variable outcome out of range'
      WHEN a.conv_id % 4 = 2 AND a.turn % 2 = 1 THEN 'variable passed without a lever' WHEN a.conv_id % 4 = 1 AND a.turn % 2 = 0 THEN 'variable failed with a lever' END AS drift
      FROM a JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn)
    SELECT item_id, drift FROM d WHERE drift IS NOT NULL""",
)
def audit_v2(t: Tables):
    base = turns(t)
    k = F.col("conv_id") % 4
    checks = C.transferability(base, "fact", "fact", "quote", LEXICONS).select("item_id", "conv_id", "turn", *C.CHECKS)
    stored = C.score_checks(checks.withColumn("variable", F.when(k == 0, "warn").when(k == 1, "fail").otherwise("pass")))
    lever = F.when((k == 3) | (F.col("turn") % 2 == 0), F.lit("layout"))
    return C.audit_v2(stored.withColumn("lever", lever), C.transferability(base, "fact", "fact", "quote", _LATER))


# --- relevance -----------------------------------------------------------------------------
_KEYS = "['that','with','this','unos','nicht','dans']"
_HIT = "len(list_filter(" + _KEYS + ", lambda k: list_contains(string_split_regex(lower({0}), '[^a-z0-9]+'), k)))"
TIER_SQL = f"""CASE WHEN record_id % 50 = 0 THEN 0 WHEN th >= 1 AND ah >= 1 THEN 1 WHEN th >= 1 OR ah >= 2 THEN 2 END"""
HITS_SQL = f"{_HIT.format('title')} AS th, {_HIT.format(chr(99) + 'oalesce(abstract, ' + chr(39) * 2 + ')')} AS ah"


def tiered(t: Tables):
    from corroborate.plans.entity import KEYWORDS

    keys = X.literals(KEYWORDS)
    pinned = F.col("record_id") % 50 == 0
    cited = F.col("record_id") % 40 == 3
    r = records(t)
    return r.withColumn("tier", C.relevance_tier(F.col("title"), F.col("abstract"), pinned, keys)).withColumn(
        "affinity", C.effect_affinity(F.col("title"), F.col("abstract"), cited, keys)
    )


@query(
    "relevance_tier",
    f"WITH {RECORDS_SQL}, h AS (SELECT *, {HITS_SQL} FROM records) SELECT record_id, CAST({TIER_SQL} AS INTEGER) AS tier FROM h",
)
def relevance_tier(t: Tables):
    return tiered(t).select("record_id", "tier")


AFFINITY_SQL = "CASE WHEN record_id % 40 = 3 THEN 0 WHEN th >= 1 AND ah >= 1 THEN 1 WHEN th >= 1 OR ah >= 2 THEN 2 ELSE 3 END"


@query(
    "effect_affinity",
    f"WITH {RECORDS_SQL}, h AS (SELECT *, {HITS_SQL} FROM records) SELECT record_id, CAST({AFFINITY_SQL} AS INTEGER) AS affinity FROM h",
)
def effect_affinity(t: Tables):
    return tiered(t).select("record_id", "affinity")
