"""Registered queries of this subpackage, each next to its oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.session import scratch_path, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(tune(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_sum_of_squares_packing")
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corroborate.llm.sum_of_squares import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op6_token_store")
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corroborate.llm.token_store import read_store, write_store

    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "token-store")
    write_store(docs, path, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return read_store(spark, path, docs)


def remainder(modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def with_held_out(docs: DataFrame, modulus: int, held: int) -> DataFrame:
    """Add held_out; a row without doc_id belongs to neither side and counts as not held out."""
    return docs.withColumn("held_out", F.coalesce(remainder(modulus) == held, F.lit(False)))


@query("op4_rank_order_profiles")
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corroborate.llm.rank_order import identify, learn_profiles

    docs = table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.filter(remainder(3) != 1)).toPandas()
    found = identify(docs.select("doc_id", "text"), profiles)
    return with_held_out(found, 3, 1).select("doc_id", "held_out", "lang_pred", "score")


@query("op5_bottom_k_fingerprints")
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corroborate.llm.bottom_k import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


@query("op1_importance_resampling")
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw as large a share of the documents as the labels call good, towards the good ones."""
    from corroborate.llm.importance import resample
    from corroborate.llm.labels import labelled_sample

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(remainder(5) != 2)
    good = labelled_sample(labels, "quality", positive=20_000, negative=0)
    share = labels.agg(F.avg("quality")).first()[0] or 0.0
    target = docs.join(F.broadcast(good.select("doc_id")), "doc_id", "left_semi")
    drawn = with_held_out(resample(docs, target, share), 5, 2)
    return drawn.select("doc_id", "held_out", "n_grams", "log_weight", "gumbel_key", "selected")


def toxicity_model(docs: DataFrame, labels: DataFrame):
    """Model of toxic segments from a bounded sample of labelled rows, none of them held out."""
    from corroborate.llm.labels import labelled_sample
    from corroborate.llm.toxic_segments import learn

    known = labels.filter(remainder(4) != 2)
    return learn(docs, labelled_sample(known, "toxic"), known.agg(F.avg("toxic")).first()[0] or 0.0)


@query("op10_toxic_segments")
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corroborate.llm.toxic_segments import score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    scored = with_held_out(score(docs, model), 4, 2)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op7_warc_bundles")
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corroborate.llm.warc_bundles import read_bundles, write_bundles

    path = scratch_path(spark, "warc")
    write_bundles(table(spark, sf_dir, "pages"), path)
    return read_bundles(spark, path)


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
_CONTAMINATION_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS_SQL} AS w FROM documents),
i AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, k, unnest(list_transform(range(0, len(w) - k + 1), lambda s: array_to_string(w[s + 1:s + k], ' '))) AS phrase
  FROM (SELECT item_id, w, least(13, len(w)) AS k FROM i WHERE len(w) > 0)),
dw AS (
  SELECT rid, k, unnest(list_transform(range(0, len(w) - k + 1), lambda s: {{'s': s, 'phrase': array_to_string(w[s + 1:s + k], ' ')}})) AS x
  FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k),
m AS (SELECT rid, x.s AS s, dw.k AS k, item_id FROM dw JOIN p ON p.k = dw.k AND p.phrase = x.phrase),
h AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(s, s + k)) AS pos FROM m) GROUP BY 1),
t AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item_id::varchar AS item FROM m) GROUP BY 1)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)"""


@query("op9_positional_index", _CONTAMINATION_SQL)
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corroborate.llm.positional_index import find_contamination

    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


_COMPONENTS_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(0, len(w) - 2), lambda i: array_to_string(w[i + 1:i + 3], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT d.doc_id, count(g)::bigint AS n_shingles FROM d LEFT JOIN s USING (doc_id) GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * k >= 90 * (x.n_shingles + y.n_shingles - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n_shingles, m.component_id FROM n JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) m USING (doc_id)"""


@query("op8_vertical_jaccard_join", _COMPONENTS_SQL)
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corroborate.llm.jaccard_join import similar_documents

    return similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op2_elias_fano_lm")
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corroborate.llm.elias_fano_lm import score_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(7) != 2).alias("learn"))
    scored = with_held_out(score_documents(docs, "learn"), 7, 2)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


# The 64-dimensional vectors of the table, as integers, of rows that take part.
_VECTORS_SQL = """
v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""
_NEGATIVES_SQL = f"""
WITH {_VECTORS_SQL},
r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, x, row_number() OVER () AS rid
  FROM v WHERE label IS NOT NULL),
s AS (
  SELECT a.vec_id AS anchor_id, a.rid AS aid, b.vec_id AS id, b.rid AS rid, a.label = b.label AS same,
    list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i]))::bigint AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.rid <> b.rid),
p AS (
  SELECT anchor_id, aid, id, score, row_number() OVER (PARTITION BY aid ORDER BY score DESC, id, rid) AS k FROM s WHERE same
  QUALIFY k <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.aid, p.k ORDER BY s.score DESC, s.id, s.rid)::int AS rank
  FROM p JOIN s ON s.aid = p.aid AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
  QUALIFY rank <= 10)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n"""


@query("op11_hard_negatives", _NEGATIVES_SQL)
def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corroborate.llm.hard_negatives import mine

    rows = table(spark, sf_dir, "embeddings")
    seventh = F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False))
    return mine(rows.withColumn("label", F.when(seventh, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Assignments and means in turn, then the digest of the last entries."""
    nearest = """
a{r} AS (
  SELECT q.rid, q.part, arg_min(e, d * 1000 + e) AS e, min(d) AS d
  FROM (SELECT q.rid, q.part, c.e, list_sum(list_transform(range(1, len(q.y) + 1), lambda i: (q.y[i] - c.y[i]) * (q.y[i] - c.y[i])))::bigint AS d
    FROM q JOIN c{r} c USING (part)) q GROUP BY 1, 2)"""
    means = """
m{r} AS (
  SELECT part, e, list(y ORDER BY i) AS y FROM (
    SELECT q.part, a.e, i, floor(sum(q.y[i])::decimal(38, 0) / count(*))::bigint AS y
    FROM q JOIN a{r} a USING (rid, part), (SELECT unnest(range(1, (SELECT max(len(y)) FROM q) + 1)) AS i) GROUP BY 1, 2, 3)
  GROUP BY 1, 2),
c{n} AS (SELECT part, e, coalesce(m{r}.y, c.y) AS y FROM c{r} c LEFT JOIN m{r} USING (part, e))"""
    steps = "".join("," + nearest.format(r=r) + "," + means.format(r=r, n=r + 1) for r in range(rounds))
    return f"""
WITH {_VECTORS_SQL},
k AS (SELECT *, row_number() OVER (ORDER BY vec_id, x) AS rid FROM v),
q AS MATERIALIZED (SELECT rid, part, x[part * len(x) // {parts} + 1:(part + 1) * len(x) // {parts}] AS y FROM k, (SELECT unnest(range({parts})) AS part)),
c0 AS (SELECT part, rid - 1 AS e, y FROM q WHERE rid <= {entries}){steps},{nearest.format(r=rounds)},
s AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{rounds}),
o AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::bigint AS error FROM a{rounds} GROUP BY 1)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::bigint AS label_error, codebooks_sha256
FROM k JOIN o USING (rid), s"""


@query("op12_ball_kmeans_codes", _codes_sql())
def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corroborate.llm.ball_kmeans import digest, learn_and_assign

    coded, books = learn_and_assign(table(spark, sf_dir, "embeddings"))
    same = [F.col("label").isNull().alias("_null"), F.coalesce(F.col("label"), F.lit(0)).alias("_label")]
    keyed = coded.select("vec_id", "codes", "error", *same)
    by_label = keyed.groupBy("_null", "_label").agg(F.sum("error").alias("label_error"))
    out = keyed.join(by_label, ["_null", "_label"])
    return out.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


@query("op13_heap_bpe_counts")
def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corroborate.llm.bpe_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
