"""Scalar and text function queries over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corroborate.functions import scalars as S
from corroborate.functions import text as X
from corroborate.functions import vocabulary as V
from corroborate.operators import novelty, relational, reports, similarity
from corroborate.plans.registry import Tables, query
from corroborate.plans.views import KEYED_SQL, RECORDS_SQL, keyed_records, norm_sql, records

_RAW_DOI = """
doi_raw AS (SELECT doc_id, CASE doc_id % 5
  WHEN 0 THEN 'https://doi.org/10.5555/AB' || doc_id WHEN 1 THEN ' DOI:10.5555/Ab' || doc_id
  WHEN 2 THEN 'http://dx.doi.org/10.5555/' || lang || doc_id WHEN 3 THEN '10.5555/' || doc_id
  ELSE source || doc_id END AS raw FROM documents)
"""


@query(
    "norm_doi",
    f"""WITH {_RAW_DOI}, bare AS (SELECT doc_id, lower(regexp_replace(regexp_replace(trim(raw),
    '^https?://(dx\\.)?doi\\.org/', '', 'i'), '^doi:', '', 'i')) AS d FROM doi_raw)
    SELECT doc_id, CASE WHEN starts_with(d, '10.') THEN d END AS doi FROM bare""",
)
def norm_doi(t: Tables):
    n = F.col("doc_id")
    raw = (
        F.when(n % 5 == 0, F.concat(F.lit("https://doi.org/10.5555/AB"), n))
        .when(n % 5 == 1, F.concat(F.lit(" DOI:10.5555/Ab"), n))
        .when(n % 5 == 2, F.concat(F.lit("http://dx.doi.org/10.5555/"), F.col("lang"), n))
        .when(n % 5 == 3, F.concat(F.lit("10.5555/"), n))
        .otherwise(F.concat(F.col("source"), n))
    )
    return t.documents.select("doc_id", X.norm_doi(raw).alias("doi"))


_NORM_TITLE = "trim(regexp_replace(strip_accents(lower(title)), '[^a-z0-9ß]+', ' ', 'g'))"


@query("norm_title", f"WITH {RECORDS_SQL} SELECT record_id, {_NORM_TITLE} AS norm_title FROM records")
def norm_title(t: Tables):
    return records(t).select("record_id", X.norm_title(F.col("title")).alias("norm_title"))


_IDENTITY = f"CASE WHEN doi IS NOT NULL THEN 'doi:' || doi WHEN {_NORM_TITLE} <> '' THEN 'title-year:' || {_NORM_TITLE} || ':' || year END"


@query("record_identity", f"WITH {RECORDS_SQL} SELECT record_id, {_IDENTITY} AS identity FROM records")
def record_identity(t: Tables):
    identity = S.record_identity(F.col("doi"), F.col("title"), F.col("year"))
    return records(t).select("record_id", identity.alias("identity"))


@query(
    "record_ids",
    f"WITH {RECORDS_SQL} SELECT record_id, 'cr_' || substr(sha256({_IDENTITY}), 1, 24) AS stable_id FROM records",
)
def record_ids(t: Tables):
    identity = S.record_identity(F.col("doi"), F.col("title"), F.col("year"))
    return records(t).select("record_id", S.record_id(identity).alias("stable_id"))


@query(
    "observation_id",
    """SELECT conv_id, turn, 'rr_' || substr(sha256(concat_ws(chr(0), 'T' || (conv_id % 7),
      lower(trim(' ' || role || ' ')), conv_id || '#' || turn,
      trim(regexp_replace(text, '\\s+', ' ', 'g')))), 1, 24) AS observation_id FROM conversations""",
)
def observation_id(t: Tables):
    ident = S.observation_id(
        F.concat(F.lit("T"), F.col("conv_id") % 7),
        F.concat(F.lit(" "), F.col("role"), F.lit(" ")),
        F.concat(F.col("conv_id"), F.lit("#"), F.col("turn")),
        F.col("text"),
    )
    return t.conversations.select("conv_id", "turn", ident.alias("observation_id"))


def _decomposed(column: str) -> str:
    out = f"lower({column})"
    for accented, base in zip("éóèñüçäêöí", "eoenucaeoi"):
        out = f"replace({out}, '{accented}', '{base}~')"
    return out


_SLUG = "substr(regexp_replace(regexp_replace({0}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 72)"


@query(
    "slug_snake",
    f"""WITH {RECORDS_SQL} SELECT record_id, {_SLUG.format(_decomposed('title'))} AS slug,
    regexp_replace(regexp_replace({_decomposed('title')}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS snake
    FROM records""",
)
def slug_snake(t: Tables):
    return records(t).select("record_id", X.slug(F.col("title")).alias("slug"), X.snake(F.col("title")).alias("snake"))


@query(
    "proposal_id",
    f"""WITH {RECORDS_SQL}, s AS (SELECT *, substr({_SLUG.format(_decomposed('title'))}, 1, 36) AS named FROM records)
    SELECT record_id, 'effect-' || topic_id || '-' || CASE WHEN named = '' THEN 'item' ELSE named END || '-' ||
      substr(sha256('effect' || chr(0) || topic_id || chr(0) || {norm_sql('title')}), 1, 12) AS proposal_id FROM s""",
)
def proposal_id(t: Tables):
    ident = S.proposal_id(F.lit("effect"), F.col("topic_id"), F.col("title"))
    return records(t).select("record_id", ident.alias("proposal_id"))


@query(
    "run_fingerprint",
    """WITH k AS (SELECT lang, coalesce(md5(text), '') AS key,
      row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS pos FROM documents),
    f AS (SELECT lang, count(*) AS keys,
      sum(CAST(('0x' || substr(md5(pos || ':' || key), 1, 15)) AS HUGEINT)) AS s FROM k GROUP BY lang)
    SELECT lang, keys, sha256('terms|' || lang || '|' || keys || '|' || CAST(s AS VARCHAR)) AS fingerprint FROM f""",
)
def run_fingerprint(t: Tables):
    keys = t.documents.select("lang", "doc_id", F.md5("text").alias("key"))
    return novelty.run_fingerprint(keys, "lang", "doc_id", "key", F.concat(F.lit("terms|"), F.col("lang")))


@query(
    "norm_provider_id",
    """WITH r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'https://openalex.org/w' || doc_id
      WHEN 1 THEN ' W' || doc_id || ' ' ELSE 'X' || doc_id END AS raw FROM documents),
    b AS (SELECT doc_id, upper(regexp_replace(trim(raw), '^https?://openalex\\.org/', '', 'i')) AS v FROM r)
    SELECT doc_id, CASE WHEN regexp_full_match(v, 'W[0-9]+') THEN v END AS provider_id FROM b""",
)
def norm_provider_id(t: Tables):
    n = F.col("doc_id")
    raw = (
        F.when(n % 3 == 0, F.concat(F.lit("https://openalex.org/w"), n))
        .when(n % 3 == 1, F.concat(F.lit(" W"), n, F.lit(" ")))
        .otherwise(F.concat(F.lit("X"), n))
    )
    return t.documents.select("doc_id", X.norm_provider_id(raw).alias("provider_id"))


@query("title_key", f"WITH {KEYED_SQL} SELECT record_id, title_key FROM keyed")
def title_key(t: Tables):
    return keyed_records(t).select("record_id", "title_key")


@query(
    "norm_quality",
    f"SELECT doc_id, md5({norm_sql('text')}) AS digest, length({norm_sql('text')}) AS chars FROM documents",
)
def norm_quality(t: Tables):
    norm = t.documents.withColumn("norm", X.norm_quality(F.col("text")))
    return norm.select("doc_id", F.md5("norm").alias("digest"), F.length("norm").alias("chars"))


@query(
    "source_text",
    f"""WITH {RECORDS_SQL} SELECT record_id, sha256(title || chr(10) || coalesce(abstract, '')) AS source_sha256,
    length(title || chr(10) || coalesce(abstract, '')) AS chars FROM records""",
)
def source_text(t: Tables):
    r = records(t).withColumn("s", X.source_text(F.col("title"), F.col("abstract")))
    return r.select("record_id", F.sha2("s", 256).alias("source_sha256"), F.length("s").alias("chars"))


@query("estimate_tokens", "SELECT doc_id, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def estimate_tokens(t: Tables):
    return t.documents.select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@query(
    "text_from_inverted_index",
    "SELECT conv_id, turn, trim(regexp_replace(text, ' +', ' ', 'g')) AS text FROM conversations",
)
def text_from_inverted_index(t: Tables):
    words = F.split("text", " ")
    index = X.bind(
        words,
        lambda w: F.map_from_entries(
            F.transform(
                F.filter(F.array_distinct(w), lambda x: x != ""),
                lambda x: F.struct(
                    x, F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i) == x)
                ),
            )
        ),
    )
    indexed = t.conversations.select(F.struct("conv_id", "turn").alias("k"), index.alias("index"))
    return relational.text_from_inverted_index(indexed, "k", "index").select("k.conv_id", "k.turn", "text")


def _words_sql(column: str, keep: str) -> str:
    return f"len(list_distinct(list_filter({column}, lambda w: {keep})))"


_STOP = "(" + ", ".join(f"'{w}'" for w in V.OVERLAP_STOPWORDS) + ")"
_GENERIC = "(" + ", ".join(f"'{w}'" for w in V.GENERIC_TERM_TOKENS) + ")"


@query(
    "token_sets",
    f"""WITH w AS (SELECT doc_id, string_split({norm_sql('text')}, ' ') AS q,
      string_split_regex(lower(text), '[^a-z0-9]+') AS r,
      string_split_regex(lower(text), '[^a-z\\x{{C0}}-\\x{{24F}}]+') AS c FROM documents),
    s AS (SELECT *, list_transform(list_filter(c, lambda x: length(x) >= 4 AND x NOT IN {_STOP}),
      lambda x: CASE WHEN ends_with(x, 's') AND NOT ends_with(x, 'ss') THEN substr(x, 1, length(x) - 1) ELSE x END) AS sing FROM w)
    SELECT doc_id, {_words_sql('q', 'length(w) > 1')} AS quality_tokens,
      {_words_sql('r', 'length(w) >= 4')} AS relevance_tokens,
      {_words_sql('r', f'length(w) >= 4 AND w NOT IN {_GENERIC}')} AS core_keywords,
      {_words_sql('sing', f'length(w) >= 4 AND w NOT IN {_STOP}')} AS content_words FROM s""",
)
def token_sets(t: Tables):
    text = F.col("text")
    return t.documents.select(
        "doc_id",
        F.size(X.quality_tokens(text)).alias("quality_tokens"),
        F.size(X.relevance_tokens(text)).alias("relevance_tokens"),
        F.size(X.core_keywords(F.array(text))).alias("core_keywords"),
        F.size(X.content_words(text)).alias("content_words"),
    )


@query(
    "sentence_split",
    """WITH p AS (SELECT doc_id, text,
      list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
        lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS s,
      list_filter(list_transform(string_split(regexp_replace(text, '(?i),\\s*(?:but|and|yet)\\s+|;\\s*|([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
        lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS c FROM documents)
    SELECT doc_id, len(s) AS sentences, len(c) AS clauses, md5(array_to_string(s, '|')) AS digest,
      CASE WHEN regexp_matches(text, '[.!?]\\s') THEN length(regexp_extract(text, '(?s)^(.*?)[.!?]\\s', 1)) + 1 ELSE -1 END AS first_end
    FROM p""",
)
def sentence_split(t: Tables):
    text = F.col("text")
    split = t.documents.select("doc_id", "text", X.sentences(text).alias("s"), X.clauses(text).alias("c"))
    return split.select(
        "doc_id",
        F.size("s").alias("sentences"),
        F.size("c").alias("clauses"),
        F.md5(F.array_join("s", "|")).alias("digest"),
        X.first_sentence_end(text).alias("first_end"),
    )


@query(
    "visible_text",
    r"""WITH b AS (SELECT page_id,
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'),
      '(?is)<svg\b[^>]*>.*?</svg>', ' ', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript>', ' ', 'g'),
      '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages),
    e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&amp;', chr(1)), '&lt;', '<'), '&gt;', '>'),
      '&quot;', '"'), '&apos;', chr(39)), '&nbsp;', ' ') AS t FROM b)
    SELECT page_id, trim(regexp_replace(replace(t, chr(1), '&'), '\s+', ' ', 'g')) AS visible FROM e""",
)
def visible_text(t: Tables):
    return t.pages.select("page_id", X.visible_text(F.col("html")).alias("visible"))


@query(
    "raw_replay_url",
    r"""SELECT page_id, regexp_replace('https://web.archive.org/web/' || lpad(CAST(page_id AS VARCHAR), 14, '2') || '/' || url,
    '/web/([0-9]{14})/', '/web/\1id_/') AS replay FROM pages""",
)
def raw_replay_url(t: Tables):
    stamp = F.lpad(F.col("page_id").cast("string"), 14, "2")
    url = F.concat(F.lit("https://web.archive.org/web/"), stamp, F.lit("/"), F.col("url"))
    return t.pages.select("page_id", X.raw_replay_url(url).alias("replay"))


_NOW = "2024-02-01 12:30:00"


@query(
    "date_scalars",
    f"""SELECT event_id, year(ts) || '-Q' || quarter(ts) AS quarter_key, strftime(ts, '%Y-%m') AS month_key,
    CAST(floor((epoch(TIMESTAMP '{_NOW}') - floor(epoch(ts))) / 3600) AS BIGINT) AS age_hours,
    CAST(floor((epoch(TIMESTAMP '{_NOW}') - floor(epoch(ts))) / 86400) AS BIGINT) AS age_days,
    CAST(weekofyear(ts) AS INTEGER) AS iso_week,
    CASE WHEN event_id % 4 = 0 THEN 'unconfigured'
      WHEN epoch(TIMESTAMP '{_NOW}') - epoch(date_trunc('day', ts)) > 20 * 86400 AND epoch(TIMESTAMP '{_NOW}') - epoch(date_trunc('day', ts)) > 90 * 86400 THEN 'stale'
      ELSE 'current' END AS price_state FROM events""",
)
def date_scalars(t: Tables):
    now = F.to_timestamp(F.lit(_NOW))
    verified = F.when(F.col("event_id") % 4 != 0, F.to_date("ts"))
    return t.events.select(
        "event_id",
        S.quarter_key(F.col("ts")).alias("quarter_key"),
        S.month_key(F.col("ts")).alias("month_key"),
        S.age_hours(F.col("ts"), now).alias("age_hours"),
        S.age_days(F.col("ts"), now).alias("age_days"),
        F.weekofyear("ts").alias("iso_week"),
        S.price_state(verified, now).alias("price_state"),
    )


@query(
    "round4",
    "SELECT l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice / l_quantity * 10000 + 0.5) / 10000 AS unit_price FROM lineitem",
)
def round4(t: Tables):
    price = S.round4(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", price)


_GRADE_LIST = "[" + ", ".join(f"'{g}'" for g in V.GRADES) + "]"
_WEIGHT_LIST = "[" + ", ".join(str(w) for w in V.PRIOR_WEIGHT) + "]"


@query(
    "grade_algebra",
    f"""WITH g AS (SELECT p_partkey, p_size % 9 AS r, CAST(p_partkey % 9 AS INTEGER) AS o FROM part)
    SELECT p_partkey, CAST(r AS INTEGER) AS grade_rank, substr({_GRADE_LIST}[r + 1], 1, 1) AS letter, r <= 4 AS at_least_b,
      {_GRADE_LIST}[greatest(r, o) + 1] AS weaker, CAST({_WEIGHT_LIST}[r + 1] AS DOUBLE) AS prior_weight FROM g""",
)
def grade_algebra(t: Tables):
    grades = X.literals(V.GRADES)
    g = t.part.select(
        "p_partkey",
        F.get(grades, F.col("p_size") % 9).alias("grade"),
        F.get(grades, (F.col("p_partkey") % 9).cast("int")).alias("other"),
    )
    return g.select(
        "p_partkey",
        S.grade_rank(F.col("grade")).cast("int").alias("grade_rank"),
        S.grade_letter(F.col("grade")).alias("letter"),
        S.grade_at_least(F.col("grade"), "B").alias("at_least_b"),
        S.weaker_grade(F.col("grade"), F.col("other")).alias("weaker"),
        S.prior_weight(F.col("grade")).alias("prior_weight"),
    )


@query(
    "status_for",
    """SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'red' WHEN c_acctbal >= 5000 THEN 'green'
    WHEN c_acctbal >= 1000 THEN 'amber' ELSE 'red' END AS status FROM customer""",
)
def status_for(t: Tables):
    score = F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal"))
    return t.customer.select("c_custkey", S.status_for(score, F.lit(5000), F.lit(1000)).alias("status"))


@query(
    "pair_key",
    """SELECT least('P' || l_partkey, 'S' || l_suppkey, 'P' || l_partkey) || '|' || greatest('P' || l_partkey, 'S' || l_suppkey) AS pair,
    count(*) AS lines FROM lineitem GROUP BY 1""",
)
def pair_key(t: Tables):
    key = S.pair_key(F.concat(F.lit("S"), F.col("l_suppkey")), F.concat(F.lit("P"), F.col("l_partkey")))
    return t.lineitem.groupBy(key.alias("pair")).agg(F.count(F.lit(1)).alias("lines"))


@query(
    "parse_counters",
    """SELECT doc_id, 'kept=' || n_chars || CASE WHEN doc_id % 4 <> 0 THEN ' lost=' || (doc_id % 4) ELSE '' END AS formatted,
    CAST(CASE WHEN doc_id % 4 <> 0 THEN 2 ELSE 1 END AS INTEGER) AS known_counters FROM documents""",
)
def parse_counters(t: Tables):
    raw = F.concat(
        F.lit("lost="), F.col("doc_id") % 4, F.lit(" kept="), F.col("n_chars"), F.lit(" a=b=7 odd=x junk")
    )
    parsed = t.documents.select("doc_id", S.known_counters(raw, ["kept", "lost", "odd"]).alias("c"))
    return parsed.select("doc_id", S.format_counters(F.col("c")).alias("formatted"), F.size("c").alias("known_counters"))


@query(
    "display_authors",
    """WITH a AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS first FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, CASE WHEN n % 5 = 0 THEN '—' WHEN n % 5 = 1 THEN 'S' || first ELSE 'S' || first || ' et al.' END AS shown FROM a""",
)
def display_authors(t: Tables):
    a = t.lineitem.groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("n"), F.min("l_suppkey").alias("first"))
    name = F.concat(F.lit("S"), F.col("first"))
    authors = F.when(F.col("n") % 5 == 0, F.array().cast("array<string>")).otherwise(
        F.array_repeat(name, (F.col("n") % 5).cast("int"))
    )
    return a.select("l_orderkey", X.display_authors(authors).alias("shown"))


@query(
    "trigger_action",
    f"""WITH {RECORDS_SQL}, d AS (SELECT record_id, 'Show   hints about ' || title ||
      CASE record_id % 3 WHEN 0 THEN ' only after the   visit' WHEN 1 THEN ' when   users stop' ELSE '' END AS c FROM records)
    SELECT record_id, CASE WHEN regexp_matches(c, '(?i)\\b(?:only after|once|after|when|if)\\b') THEN
      substr(c, length(regexp_extract(c, '(?is)^(.*?)\\b(?:only after|once|after|when|if)\\b', 1)) + 1) ELSE '' END AS trigger_part,
      CASE WHEN regexp_matches(c, '(?i)\\b(?:only after|once|after|when|if)\\b') THEN
      regexp_extract(c, '(?is)^(.*?)\\b(?:only after|once|after|when|if)\\b', 1) ELSE c END AS action_part FROM d""",
)
def trigger_action(t: Tables):
    tail = (
        F.when(F.col("record_id") % 3 == 0, " only after the {first} visit")
        .when(F.col("record_id") % 3 == 1, " when three users stop")
        .otherwise("")
    )
    directive = F.concat(F.lit("Show {n} hints about "), F.col("title"), tail)
    parts = records(t).select("record_id", X.trigger_action(directive).alias("p"))
    return parts.select("record_id", F.col("p.trigger").alias("trigger_part"), F.col("p.action").alias("action_part"))


@query(
    "dissent_citation",
    f"""WITH {RECORDS_SQL}, d AS (SELECT record_id, trim(title || CASE WHEN record_id % 2 = 0 THEN ' (' || year || ')' ELSE '' END, ' ' || chr(10)) AS lead FROM records),
    c AS (SELECT record_id, CASE WHEN regexp_matches(lead, ':\\s') THEN regexp_extract(lead, '(?s)^(.*?):\\s', 1) ELSE lead END AS lead FROM d)
    SELECT record_id, CASE WHEN regexp_matches(lead, '\\b(?:19|20)[0-9]{{2}}\\b') AND NOT contains(lead, '. ') AND length(lead) <= 160 THEN lead END AS citation FROM c""",
)
def dissent_citation(t: Tables):
    dated = F.when(F.col("record_id") % 2 == 0, F.concat(F.lit(" ("), F.col("year"), F.lit(")"))).otherwise("")
    text = F.concat(F.col("title"), dated, F.lit(": the opposite holds."))
    return records(t).select("record_id", X.dissent_citation(text).alias("citation"))


@query(
    "status_phrases",
    """SELECT p_partkey, replace(p_type || '_' || p_brand, '_', ' ') AS human, p_name AS predicate,
    CASE p_partkey % 3 WHEN 0 THEN 'forbidden' ELSE 'forbidden — ' || p_name END AS boundary FROM part""",
)
def status_phrases(t: Tables):
    rule = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Never use "), F.col("p_name"), F.lit(" on your page"))).otherwise(
        F.concat(F.lit("Do not "), F.col("p_name"))
    )
    return t.part.select(
        "p_partkey",
        X.humanize(F.concat_ws("_", "p_type", "p_brand")).alias("human"),
        X.strip_predicate(F.concat(F.col("p_name"), F.lit(" == true"))).alias("predicate"),
        X.boundary_reason(rule).alias("boundary"),
    )


_PAIRS = """
pairs AS (SELECT a.conv_id, a.turn, {na} AS hay, {nb} AS needle
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
""".format(na=norm_sql("a.text"), nb=norm_sql("b.text"))


def _turn_pairs(t: Tables):
    a = t.conversations.select("conv_id", "turn", X.norm_quality(F.col("text")).alias("hay"))
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), X.norm_quality(F.col("text")).alias("needle"))
    return a.join(b, ["conv_id", "turn"])


@query(
    "refusal_diagnostics",
    f"""WITH {_PAIRS} SELECT conv_id, turn,
      CAST(list_max(list_filter(range(0, length(needle) + 1), lambda i: contains(hay, substr(needle, 1, i)))) AS BIGINT) AS contained_prefix,
      CAST(list_max(list_filter(range(0, least(length(hay), length(needle)) + 1), lambda i: substr(hay, 1, i) = substr(needle, 1, i))) AS BIGINT) AS divergence
    FROM pairs""",
)
def refusal_diagnostics(t: Tables):
    return _turn_pairs(t).select(
        "conv_id",
        "turn",
        X.longest_contained_prefix(F.col("hay"), F.col("needle")).alias("contained_prefix"),
        X.first_divergence(F.col("hay"), F.col("needle")).alias("divergence"),
    )


@query(
    "voice_violations",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, count(*) + 1 AS violations FROM l
    WHERE regexp_matches(line, '(?i)\\b(?:you|your|should|prefer)\\b') AND NOT starts_with(ltrim(line), '#') GROUP BY doc_id
    UNION ALL SELECT doc_id, 1 FROM documents WHERE NOT regexp_matches(text, '(?i)\\b(?:you|your|should|prefer)\\b')
    UNION ALL SELECT DISTINCT doc_id, 1 FROM l WHERE regexp_matches(line, '(?i)\\b(?:you|your|should|prefer)\\b') AND starts_with(ltrim(line), '#')
      AND doc_id NOT IN (SELECT doc_id FROM l WHERE regexp_matches(line, '(?i)\\b(?:you|your|should|prefer)\\b') AND NOT starts_with(ltrim(line), '#'))""",
)
def voice_violations(t: Tables):
    block = F.lit("\nYou should see this\n# you may read this\nimplementations:\nyou may\ninteractions:\nplain")
    found = reports.voice_violations(F.concat(F.col("text"), block))
    return t.documents.select("doc_id", F.size(found).cast("bigint").alias("violations"))


@query(
    "array_helpers",
    """WITH a AS (SELECT l_orderkey, list_distinct(list(l_returnflag)) AS f, list_distinct(list(l_linestatus)) AS s FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_concat(f, s))), ',') AS merged,
    array_to_string(list_sort(list_filter(f, lambda x: x IN ('A', 'R'))), ',') AS known FROM a""",
)
def array_helpers(t: Tables):
    a = t.lineitem.groupBy("l_orderkey").agg(
        F.collect_set("l_returnflag").alias("f"), F.collect_set("l_linestatus").alias("s")
    )
    return a.select(
        "l_orderkey",
        F.array_join(F.array_sort(F.array_union("f", "s")), ",").alias("merged"),
        F.array_join(F.array_sort(F.array_intersect("f", X.literals(["A", "R"]))), ",").alias("known"),
    )


@query(
    "pattern_parameters",
    """SELECT p_partkey, array_to_string(list_concat(
      CASE WHEN p_partkey % 3 = 0 THEN ['undeclared:limit'] ELSE [] END,
      CASE WHEN p_partkey % 2 = 0 THEN ['unused:spare'] ELSE [] END,
      CASE WHEN p_partkey % 5 = 0 THEN ['bare_number:three'] ELSE [] END), ',') AS errors FROM part""",
)
def pattern_parameters(t: Tables):
    n = F.col("p_partkey")
    pattern = F.concat(
        F.lit("Offer {count} of "),
        F.col("p_name"),
        F.when(n % 3 == 0, " below {limit}").otherwise(""),
        F.when(n % 5 == 0, " up to three times").otherwise(""),
    )
    declared = F.when(n % 2 == 0, X.literals(["count", "spare"])).otherwise(X.literals(["count"]))
    errors = similarity.pattern_parameter_errors(pattern, declared)
    return t.part.select("p_partkey", F.array_join(errors, ",").alias("errors"))
