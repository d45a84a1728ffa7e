"""Sources, sinks and streams, driven by the given tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.functions import text as X
from corroborate.plans.analytics import DETAIL_SQL, _detail, weekly_attempts
from corroborate.plans.registry import Tables, query
from corroborate.plans.views import RECORDS_SQL, norm_sql, records
from corroborate.session import cut_lineage, scratch_path
from corroborate.sources import readers, sinks
from corroborate.streaming import incremental as I


# --- sources -----------------------------------------------------------------------------
@query(
    "read_evidence",
    f"WITH {RECORDS_SQL} SELECT record_id, topic_id, title, md5(coalesce(abstract, '')) AS abstract_md5, citations, doi FROM records",
)
def read_evidence(t: Tables):
    """documents landed as one JSON corpus file per record, then read back."""
    path = scratch_path(t.spark, "evidence")
    r = records(t)
    one = F.struct(F.col("record_id").cast("string").alias("record_id"), "title", "year", "doi", "citations", "abstract", "openalex_id", "source_api")
    files = r.select(F.col("topic_id").alias("mechanism_id"), F.array(one).alias("records"))
    # A corpus file is one JSON document; the reader takes JSON lines the same way.
    files.write.json(path)
    back = t.spark.read.schema(readers.EVIDENCE_FILE).json(path).select(
        F.col("mechanism_id").alias("topic_id"), F.inline("records")
    )
    return back.select(
        F.col("record_id").cast("bigint").alias("record_id"),
        "topic_id",
        "title",
        F.md5(F.coalesce("abstract", F.lit(""))).alias("abstract_md5"),
        "citations",
        "doi",
    )


@query(
    "markdown_report",
    "SELECT p_partkey, p_name AS metric, p_retailprice AS value, p_brand AS unit FROM part WHERE p_partkey % 9 <> 4",
)
def markdown_report(t: Tables):
    """Each part as a small Markdown report; rows with a broken value are quarantined."""
    value = F.when(F.col("p_partkey") % 9 == 4, "n/a").otherwise(F.col("p_retailprice").cast("string"))
    table = F.concat(
        F.lit("# Report\n\n| Metric | Value | Unit |\n|---|---:|---|\n| "), "p_name", F.lit(" | "), value, F.lit(" | "), "p_brand", F.lit(" |\n\n| not | this |\n")
    )
    rows = readers.markdown_rows(t.part.select("p_partkey", table.alias("md")), "md")
    cells = [F.col("cells")[c].alias(c) for c in ("metric", "category", "value", "unit", "notes")]
    good, _ = readers.normalise_metric_rows(rows.select("p_partkey", *cells))
    return good.select("p_partkey", "metric", "value", "unit")


@query(
    "metric_quarantine",
    """WITH r AS (SELECT l_orderkey, CASE WHEN l_linenumber = 1 THEN 'metric_empty' WHEN l_linenumber = 2 THEN 'unit_empty' WHEN l_linenumber = 3 THEN 'value_empty' WHEN l_linenumber = 4 THEN 'value_not_finite' END AS reason FROM lineitem)
    SELECT reason, count(*) AS rows FROM r WHERE reason IS NOT NULL GROUP BY 1 UNION ALL SELECT 'accepted', count(*) FROM r WHERE reason IS NULL""",
)
def metric_quarantine(t: Tables):
    n = F.col("l_linenumber")
    rows = t.lineitem.select(
        F.when(n == 1, "  ").otherwise("price").alias("metric"),
        F.lit(None).cast("string").alias("category"),
        F.when(n == 3, " ").when(n == 4, "12 x").otherwise(F.col("l_extendedprice").cast("string")).alias("value"),
        F.when(n != 2, "usd").alias("unit"),
        F.lit(" ").alias("notes"),
    )
    good, bad = readers.normalise_metric_rows(rows)
    accepted = good.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("accepted").alias("reason"), "rows")
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("rows")).unionByName(accepted)


@query(
    "api_pages",
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'openalex' ELSE 'semantic-scholar' END AS source_api, role AS title,
    trim(regexp_replace(text, ' +', ' ', 'g')) AS abstract, '10.5555/' || conv_id AS doi, CASE WHEN turn % 2 = 0 THEN 'W' || conv_id END AS openalex_id, conv_id * 10 AS provider_total,
    CASE WHEN turn % 3 = 0 THEN 'A. Author' ELSE '' END AS authors FROM conversations WHERE turn % 5 <> 4""",
)
def api_pages(t: Tables):
    """Conversation turns wrapped as raw result pages of the two providers."""
    c = t.conversations
    words = F.filter(F.split("text", " "), lambda w: w != "")
    index = X.bind(
        words,
        lambda w: F.map_from_entries(
            F.transform(
                F.array_distinct(w),
                lambda x: F.struct(x, F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i) == x)),
            )
        ),
    )
    title = F.when(F.col("turn") % 5 != 4, F.col("role"))
    name = F.when(F.col("turn") % 3 == 0, "A. Author")
    doi = F.concat(F.lit("https://doi.org/10.5555/"), "conv_id")
    none = F.lit(None).cast("string")
    work = F.struct(
        F.concat(F.lit("https://openalex.org/W"), "conv_id").alias("id"), F.lit("article").alias("type"), doi.alias("doi"), title.alias("title"),
        none.alias("display_name"), F.col("turn").cast("int").alias("publication_year"), F.col("conv_id").alias("cited_by_count"),
        F.array(F.struct(F.struct(name.alias("display_name")).alias("author"))).alias("authorships"),
        F.struct(F.struct(none.alias("display_name")).alias("source")).alias("primary_location"),
        index.alias("abstract_inverted_index"), F.lit(3).alias("referenced_works_count"),
    )
    paper = F.struct(
        title.alias("title"), F.array(F.struct(name.alias("name"))).alias("authors"), F.col("turn").cast("int").alias("year"), none.alias("venue"),
        F.col("conv_id").alias("citationCount"), F.array_join(words, " ").alias("abstract"), F.struct(doi.alias("DOI")).alias("externalIds"),
    )
    pages = c.filter("turn % 2 = 0").select(F.struct((F.col("conv_id") * 10).alias("count")).alias("meta"), F.array(work).alias("results"))
    listed = c.filter("turn % 2 = 1").select((F.col("conv_id") * 10).alias("total"), F.array(paper).alias("data"))
    both = readers.works_to_records(pages).unionByName(readers.papers_to_records(listed))
    return both.select(
        F.col("citations").alias("conv_id"), F.col("year").cast("bigint").alias("turn"), "source_api", "title", "abstract", "doi", "openalex_id",
        "provider_total", F.array_join("authors", ",").alias("authors"),
    )


@query(
    "capture_index",
    """SELECT o_custkey AS domain, strftime(o_orderdate, '%Y-%m-%d') AS date, 'https://web.archive.org/web/' || strftime(o_orderdate, '%Y%m%d%H%M%S') || '/http://x/' || o_orderkey AS wayback_url FROM orders WHERE o_orderkey % 10 <> 0""",
)
def capture_index(t: Tables):
    stamp = F.when(F.col("o_orderkey") % 10 == 0, "timestamp").otherwise(F.date_format("o_orderdate", "yyyyMMddHHmmss"))
    rows = t.orders.select(F.col("o_custkey").alias("domain"), stamp.alias("timestamp"), F.concat(F.lit("http://x/"), "o_orderkey").alias("original"))
    return readers.captures(rows).select("domain", "date", "wayback_url")


@query(
    "inventory_counts",
    "SELECT s_name AS path, CAST(coalesce(n, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END, 0) AS BIGINT) AS records FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-03-01' GROUP BY 1) ON l_suppkey = s_suppkey",
)
def inventory_counts(t: Tables):
    files = t.supplier.select(F.col("s_name").alias("path"), "s_suppkey")
    early = t.lineitem.filter(F.col("l_shipdate") < F.to_timestamp(F.lit("1995-03-01")))
    run = early.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("records")).join(files, "s_suppkey")
    previous = files.filter("s_suppkey % 2 = 0").select("path", F.col("s_suppkey").alias("records"))
    return readers.inventory_counts(files.select("path"), run, previous)


# --- sinks -------------------------------------------------------------------------------
@query("write_snapshot", "SELECT l_returnflag, l_linestatus, count(*) AS lines FROM lineitem GROUP BY 1, 2")
def write_snapshot(t: Tables):
    path = scratch_path(t.spark, "snapshot")
    rows = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("lines"))
    sinks.write_snapshot(rows, path, ["l_returnflag", "l_linestatus"])
    return t.spark.read.parquet(path)


@query(
    "write_scoped",
    "SELECT c_mktsegment AS row, c_nationkey AS segment, count(*) + CASE WHEN c_mktsegment = 'MACHINERY' THEN 1000 ELSE 0 END AS score FROM customer GROUP BY 1, 2",
)
def write_scoped(t: Tables):
    """A full matrix is written, then one row is recomputed and only it is replaced."""
    path = scratch_path(t.spark, "matrix")
    grid = t.customer.groupBy(F.col("c_mktsegment").alias("row"), F.col("c_nationkey").alias("segment")).agg(F.count(F.lit(1)).alias("score"))
    grid = grid.withColumn("version", F.lit("v1"))
    grid.write.partitionBy("row").parquet(path)
    part = grid.filter("row = 'MACHINERY'").withColumn("score", F.col("score") + 1000)
    sinks.write_scoped(part, path, grid.select("row", "segment"), "v1")
    return t.spark.read.parquet(path).select("row", "segment", "score")


@query(
    "guarded_overwrite",
    "SELECT CASE WHEN i = 1 THEN 'kept' ELSE 'side' END AS place, CASE WHEN i = 1 THEN (SELECT count(*) FROM orders) ELSE (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') END AS rows FROM range(1, 3) r(i)",
)
def guarded_overwrite(t: Tables):
    """A smaller re-run must not replace the larger set already in place."""
    path, side = scratch_path(t.spark, "corpus"), scratch_path(t.spark, "regression")
    sinks.guarded_overwrite(t.orders, path, side)
    sinks.guarded_overwrite(t.orders.filter("o_orderstatus = 'F'"), path, side)
    count = lambda p, name: t.spark.read.parquet(p).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("place"), "rows")
    return count(path, "kept").unionByName(count(side, "side"))


@query(
    "merge_latest",
    "SELECT o_custkey, arg_max(o_totalprice, (o_orderdate >= TIMESTAMP '1999-01-01', o_orderkey)) AS o_totalprice FROM orders GROUP BY 1",
)
def merge_latest(t: Tables):
    path = scratch_path(t.spark, "ledger")
    rows = t.orders.select("o_custkey", "o_totalprice", "o_orderkey", "o_orderdate")
    new = F.col("o_orderdate") >= F.to_timestamp(F.lit("1999-01-01"))
    rows.filter(~new).drop("o_orderdate").write.parquet(path)
    sinks.merge_latest(rows.filter(new).drop("o_orderdate"), path, ["o_custkey"], "o_orderkey")
    return t.spark.read.parquet(path).select("o_custkey", "o_totalprice")


@query(
    "rejection_log",
    f"WITH {DETAIL_SQL} SELECT candidate_id, {norm_sql('text')} AS quote_normalized, length(text) AS quote_chars FROM detail JOIN (SELECT conv_id, turn, text FROM conversations) c USING (conv_id, turn) WHERE fate = 'dropped_ungrounded'",
)
def rejection_log(t: Tables):
    path = scratch_path(t.spark, "rejected")
    texts = t.conversations.select(F.concat_ws(":", "conv_id", "turn").alias("candidate_id"), "text")
    refused = _detail(t).filter("fate = 'dropped_ungrounded'").join(texts, "candidate_id")
    sinks.append(sinks.rejection_log(refused, F.col("text"), F.col("text")), path)
    return t.spark.read.parquet(path).select("candidate_id", "quote_normalized", F.length("quote_raw").alias("quote_chars"))


# --- streams ------------------------------------------------------------------------------
def landed(t: Tables, df: DataFrame, name: str, files: int = 4) -> DataFrame:
    """``df`` written as files and opened as a stream."""
    path = scratch_path(t.spark, name)
    df.repartition(files).write.parquet(path)
    return t.spark.readStream.schema(t.spark.read.parquet(path).schema).parquet(path)


def run_stream(t: Tables, stream: DataFrame, name: str, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over everything landed so far and read its result table.

    In update mode the newest row of a key counts; batches land in their own
    folders, so a replayed batch replaces itself.
    """
    out, log = scratch_path(t.spark, name), scratch_path(t.spark, f"{name}-log")
    _drain(stream, out, log, mode, keys)
    return I.read_upserts(t.spark, out, keys) if keys else t.spark.read.parquet(out).drop("batch")


def _drain(stream: DataFrame, out: str, log: str, mode: str, keys: list[str] | None) -> None:
    write = I.upsert_batch(out, keys, keys[0]) if keys else _append_batch(out)
    run = stream.writeStream.outputMode(mode).option("checkpointLocation", log).foreachBatch(write)
    run.trigger(availableNow=True).start().awaitTermination()


SLICES = 3  # arrivals land in this many steps, each a micro-batch of several files


def sliced(df: DataFrame, slices: int) -> DataFrame:
    """``slice`` 0, 1, ...: equal spans of the whole seconds ``arrival`` (null: the first)."""
    low, high = df.agg(F.min("arrival"), F.max("arrival")).head()
    at = F.expr(f"(arrival - {low or 0}) * {slices} div {(high or 0) - (low or 0) + 1}")
    return cut_lineage(df.withColumn("slice", F.coalesce(at, F.lit(0))))


def run_out_of_order(t: Tables, rows: DataFrame, build, name: str, keys: list[str], event_time: str, end: str) -> DataFrame:
    """Run ``build(stream)`` over rows that land up to two days after their event time.

    They land in slices, in no order inside one; each is read after a restart. A last row
    without key, of event time ``end``, moves the watermark past everything.
    """
    src, out, log = (scratch_path(t.spark, f"{name}-{part}") for part in ("in", "out", "log"))
    jitter = F.pmod(F.xxhash64(*rows.columns), F.lit(2 * 86400 - 60))
    arriving = sliced(rows.withColumn("arrival", F.unix_seconds(event_time) + jitter), SLICES)
    last = t.spark.range(1).select(
        *[F.lit(end if f.name == event_time else None).cast(f.dataType).alias(f.name) for f in rows.schema]
    )
    parts = [arriving.filter(F.col("slice") == at).select(rows.columns).repartition(4) for at in range(SLICES)]
    for part in [*parts, last]:
        part.write.mode("append").parquet(src)
        _drain(build(t.spark.readStream.schema(rows.schema).parquet(src)), out, log, "update", keys)
    return I.read_upserts(t.spark, out, keys)


def _append_batch(path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


@query(
    "stream_dedupe",
    "SELECT user_id, event_type, count(*) AS rows FROM (SELECT DISTINCT user_id, event_type, CAST(floor(value) AS BIGINT) AS v FROM events) GROUP BY 1, 2",
)
def stream_dedupe(t: Tables):
    e = t.events.select(
        F.concat_ws("|", "user_id", "event_type", F.floor("value")).alias("key"), "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")
    )
    stream = I.stream_dedupe(landed(t, e, "events"), "key", "ts", "60 days")
    return run_stream(t, stream, "unique", "append").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "stream_spend",
    """SELECT event_type AS corpus, date_trunc('month', ts) AS month, count(*) AS runs, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS spent,
    CASE WHEN sum(value) >= 100000 THEN 'paused' WHEN sum(value) >= 80000 THEN 'warning' ELSE 'normal' END AS level FROM events GROUP BY 1, 2""",
)
def stream_spend(t: Tables):
    e = t.events.select(F.col("event_type").alias("corpus"), F.col("ts").cast("timestamp").alias("ts"), "value")
    stream = I.stream_spend(landed(t, e, "spend"), "ts", "value", "10 minutes", 100000)
    out = run_stream(t, stream, "month", "update", ["corpus", "month"])
    return out.withColumn("spent", F.col("spent").cast("double")).withColumn("month", F.col("month").cast("timestamp_ntz"))


@query(
    "stream_freshness",
    """WITH n AS (SELECT user_id AS source_id, max(ts) AS ts, arg_max(event_type, (ts, event_type)) AS s FROM events GROUP BY 1)
    SELECT source_id, CASE WHEN floor((epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts))) / 3600) >= 12 THEN 'unknown' ELSE s END AS status FROM n""",
)
def stream_freshness(t: Tables):
    e = t.events.select(F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"))
    newest = run_out_of_order(t, e, lambda s: I.stream_freshness(s, "ts", "2 days"), "health", ["source_id"], "ts", "2024-02-02")
    return newest.select(F.col("source_id").cast("bigint").alias("source_id"), "status")


@query(
    "stream_late_rows",
    """WITH a AS (SELECT event_id, ts, CAST(floor(epoch(ts)) AS BIGINT) + event_id % 86400 + CASE WHEN event_id % 50 = 0 THEN 864000 ELSE 0 END AS arrival FROM events),
    b AS (SELECT event_id, ts, (arrival - min(arrival) OVER ()) * 3 // (max(arrival) OVER () - min(arrival) OVER () + 1) AS batch FROM a),
    m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM b GROUP BY 1)
    SELECT event_id, CAST(batch AS INTEGER) AS batch, coalesce(ts < mark - INTERVAL 2 DAY, false) AS late FROM b JOIN m USING (batch)""",
)
def stream_late_rows(t: Tables):
    """Every row is either on time or late; three arrivals, each after a restart."""
    ts = F.col("ts").cast("timestamp")
    arrival = F.unix_seconds(ts) + F.col("event_id") % 86400 + F.when(F.col("event_id") % 50 == 0, 864000).otherwise(0)
    rows = sliced(t.events.select("event_id", ts.alias("ts"), arrival.alias("arrival")), 3)
    src, out, log = (scratch_path(t.spark, f"late-{part}") for part in ("in", "out", "log"))
    for at in range(3):
        rows.filter(F.col("slice") == at).select("event_id", "ts").repartition(4).write.mode("append").parquet(src)
        stream = t.spark.readStream.schema("event_id bigint, ts timestamp").parquet(src)
        run = stream.writeStream.option("checkpointLocation", log).foreachBatch(I.split_late(out, "ts", timedelta(days=2)))
        run.trigger(availableNow=True).start().awaitTermination()
    return I.read_split(t.spark, out).select("event_id", "batch", "late")


@query(
    "stream_streak",
    """WITH w AS (SELECT user_id AS topic_id, event_type AS segment, strftime(ts, '%Y-%m-%d') AS week, bool_and(value < 40) AS low FROM events GROUP BY 1, 2, 3),
    l AS (SELECT topic_id, segment, max(week) FILTER (WHERE NOT low) AS last FROM w GROUP BY 1, 2)
    SELECT topic_id, segment, count_if(last IS NULL OR week > last) AS streak, min(week) FILTER (WHERE last IS NULL OR week > last) AS streak_since, count(*) AS attempts FROM w JOIN l USING (topic_id, segment) GROUP BY 1, 2""",
)
def stream_streak(t: Tables):
    weekly = weekly_attempts(t).withColumn("at", F.to_timestamp("week"))
    out = run_out_of_order(t, weekly, lambda s: I.stream_streak(s, "at", "2 days"), "streaks", ["topic_id", "segment"], "at", "2024-03-01")
    return out.withColumn("topic_id", F.col("topic_id").cast("bigint"))


@query(
    "stream_saturation",
    """WITH c AS (SELECT user_id AS topic_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step, floor(value) / 1000 AS rate FROM events),
    r AS (SELECT topic_id, step, CASE WHEN count(*) OVER w = 10 THEN floor(sum(CAST(round(rate * 10000) AS BIGINT)) OVER w / 10 + 0.5) / 10000 END AS rolling FROM c WINDOW w AS (PARTITION BY topic_id ORDER BY step ROWS 9 PRECEDING))
    SELECT topic_id, min(step) AS step, arg_min(rolling, step) AS rolling_rate FROM r WHERE step >= 30 AND rolling < 0.03 GROUP BY 1""",
)
def stream_saturation(t: Tables):
    rate = (F.floor("value") / 1000).alias("novelty_rate")
    e = t.events.select(F.col("user_id").alias("topic_id"), F.col("event_id").alias("query_index"), rate, F.col("ts").cast("timestamp").alias("ts"))
    judge = lambda s: I.stream_saturation(s, "ts", "2 days", 10, 30, 0.03)
    out = run_out_of_order(t, e, judge, "stops", ["topic_id"], "ts", "2024-03-01")
    return out.withColumn("topic_id", F.col("topic_id").cast("bigint"))


@query(
    "stream_upsert",
    "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2",
)
def stream_upsert(t: Tables):
    """Replayed keys: the later batch replaces the row the earlier one wrote."""
    out = scratch_path(t.spark, "upserts")
    rows = t.events.select("user_id", "event_type", "value", "event_id", "ts")
    split = F.to_timestamp(F.lit("2024-01-20"))
    write = I.upsert_batch(out, ["user_id", "event_type"], "event_id")
    for batch, part in enumerate([rows.filter(F.col("ts") < split), rows.filter(F.col("ts") >= split)]):
        run = landed(t, part.drop("ts"), "rows").writeStream.option("checkpointLocation", scratch_path(t.spark, "upserts-log"))
        run = run.foreachBatch(lambda df, _, n=batch: write(df, n))
        run.trigger(availableNow=True).start().awaitTermination()
    return I.read_upserts(t.spark, out, ["user_id", "event_type"])


@query(
    "stream_harvest",
    """WITH k AS (SELECT user_id % 10 AS q, CAST(floor(value * 10) AS BIGINT) AS key FROM events), f AS (SELECT key, min(q) AS q FROM k GROUP BY 1)
    SELECT q AS query_index, (SELECT count(DISTINCT key) FROM k WHERE k.q = x.q) AS unique_returned, (SELECT count(*) FROM f WHERE f.q = x.q) AS records_added FROM (SELECT DISTINCT q FROM k) x""",
)
def stream_harvest(t: Tables):
    """Landed query results become new records once, with one novelty row per query."""
    out, log = scratch_path(t.spark, "harvest"), scratch_path(t.spark, "harvest-log")
    hits = t.events.select((F.col("user_id") % 10).alias("query_index"), F.floor(F.col("value") * 10).alias("key"))
    _harvest(landed(t, hits, "hits"), out, log)
    return I.read_harvest(t.spark, out)


def _harvest(stream: DataFrame, out: str, log: str) -> None:
    run = I.stream_harvest(stream, "key").writeStream.option("checkpointLocation", log)
    run.foreachBatch(I.harvest_batch(out, "key")).trigger(availableNow=True).start().awaitTermination()


@query(
    "stream_harvest_spanning",
    """WITH a AS (SELECT user_id % 10 AS q, CAST(floor(value * 10) AS BIGINT) AS key, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events),
    k AS (SELECT q, key, (sec - min(sec) OVER ()) * 3 // (max(sec) OVER () - min(sec) OVER () + 1) AS batch FROM a),
    f AS (SELECT key, arg_min(q, (batch, q)) AS q FROM k GROUP BY 1)
    SELECT q AS query_index, (SELECT count(DISTINCT key) FROM k WHERE k.q = x.q) AS unique_returned, (SELECT count(*) FROM f WHERE f.q = x.q) AS records_added FROM (SELECT DISTINCT q FROM k) x""",
)
def stream_harvest_spanning(t: Tables):
    """The hits of every query come in three micro-batches, each after a restart."""
    hits = t.events.select(
        (F.col("user_id") % 10).alias("query_index"),
        F.floor(F.col("value") * 10).alias("key"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("arrival"),
    )
    rows = sliced(hits, SLICES)
    src, out, log = (scratch_path(t.spark, f"harvest-{part}") for part in ("in", "out", "log"))
    for at in range(SLICES):
        rows.filter(F.col("slice") == at).select("query_index", "key").repartition(4).write.mode("append").parquet(src)
        _harvest(t.spark.readStream.schema("query_index bigint, key bigint").parquet(src), out, log)
    return I.read_harvest(t.spark, out)
