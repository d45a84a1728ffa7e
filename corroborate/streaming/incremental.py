"""Incremental operators as Structured Streaming queries."""

from __future__ import annotations

import bisect
import json
import sys
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from corroborate.functions.scalars import seconds
from corroborate.operators.skew import latest_per_key
from corroborate.session import cut_lineage


# Workers receive the functions of this module by value and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stream_dedupe(stream: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """First row per key while it may still be repeated."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def stream_spend(stream: DataFrame, event_time: str, amount: str, delay: str, cap: float) -> DataFrame:
    """Month-to-date spend per corpus with an alert from 80 % of the cap on."""
    month = F.date_trunc("month", F.col(event_time)).alias("month")
    summed = stream.withWatermark(event_time, delay).groupBy("corpus", month).agg(
        F.count(F.lit(1)).alias("runs"), F.sum(F.col(amount).cast("decimal(18,4)")).alias("spent")
    )
    return summed.withColumn(
        "level", F.when(F.col("spent") >= cap, "paused").when(F.col("spent") >= 0.8 * cap, "warning").otherwise("normal")
    )


# A call of a Python worker costs more than a key's few rows, so keys share state rows by hash.
KEY_GROUPS = 1024
KEPT = "kept string"


def _group(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(KEY_GROUPS)).alias("key_group")


def _kept(state: GroupState) -> dict:
    """What is kept of each key of the group, as a list per key."""
    return {tuple(key): kept for key, kept in json.loads(state.get[0])} if state.exists else {}


def _keep(state: GroupState, kept: dict, dues: Iterator[int]) -> None:
    """Keep the keys of the group until the first of their timers."""
    if not kept:
        if state.exists:
            state.remove()
        return
    state.update((json.dumps(list(kept.items())),))
    due = min(dues, default=None)
    if due is not None:
        state.setTimeoutTimestamp(due)


def _rows(batches: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    """The rows of a group whose first column, the key, is not null."""
    for batch in batches:
        yield from (row for row in zip(*(batch[c].tolist() for c in columns)) if row[0] is not None)


BEAT_OUT = "source_id string, checked_millis bigint, status string"


def stream_freshness(stream: DataFrame, event_time: str, delay: str = "12 hours", hours: int = 12) -> DataFrame:
    """Newest heartbeat per source (``source_id``, ``status``); ``unknown`` once it is ``hours`` old.

    State holds the sources that still report, in ``KEY_GROUPS`` rows: a timer on event time
    writes the row ``unknown`` and removes the source. Age counts whole seconds. Of beats of one moment the
    greatest status counts; rows behind the watermark are ignored (``split_late`` keeps them
    aside). A row without source moves the watermark only.
    """

    def judge(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, watermark, out = _kept(state), state.getCurrentWatermarkMs(), {}
        due = lambda beat: beat[0] // 1000 * 1000 + hours * 3_600_000
        for source, millis, status in _rows(batches, "source_id", "checked_millis", "status"):
            kept[source,] = out[source] = max(tuple(kept.get((source,), (-1, ""))), (millis, status))
        for (source,), beat in list(kept.items()):
            if due(beat) <= watermark:
                out[source] = (kept.pop((source,))[0], "unknown")
        _keep(state, kept, (due(beat) - 1 for beat in kept.values()))
        if out:
            yield pd.DataFrame([(source, *beat) for source, beat in out.items()], columns=["source_id", "checked_millis", "status"])

    beats = stream.withWatermark(event_time, delay).select(
        _group("source_id"),
        F.col("source_id").cast("string").alias("source_id"),
        event_time,
        F.unix_millis(event_time).alias("checked_millis"),
        F.coalesce("status", F.lit("unknown")).alias("status"),
    )
    judged = beats.groupBy("key_group").applyInPandasWithState(
        judge, BEAT_OUT, KEPT, "update", GroupStateTimeout.EventTimeTimeout
    )
    return judged.select("source_id", F.timestamp_millis("checked_millis").alias("checked_at"), "status")


def stale_to_unknown(newest: DataFrame, now, hours: int = 12) -> DataFrame:
    age = F.floor((seconds(now) - seconds(F.col("checked_at"))) / 3600)
    return newest.withColumn("status", F.when(age >= hours, "unknown").otherwise(F.col("status")))


STREAK_OUT = "topic_id string, segment string, streak bigint, streak_since string, attempts bigint"


def _closed(pending: list, watermark: int) -> int:
    """Length of the prefix of sorted pending rows (event millis first) that no row can precede any more."""
    return bisect.bisect_right(pending, watermark, key=lambda row: row[0])


def _follow(fold: tuple, pending: list) -> tuple:
    streak, since, last, attempts = fold
    for _, week, low in pending:
        streak, since = (streak + 1, since if streak else week) if low else (0, None)
        last, attempts = week, attempts + 1
    return streak, since, last, attempts


def _streak(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    kept, watermark, seen = _kept(state), state.getCurrentWatermarkMs(), {}
    for topic, segment, millis, week, low in _rows(batches, "topic_id", "segment", "millis", "week", "low_novelty"):
        *fold, pending = kept.setdefault((topic, segment), [0, None, "", 0, []])
        weeks = seen.setdefault((topic, segment), {row[1]: row for row in pending})
        if week > fold[2]:
            weeks[week] = [millis, week, low]
    out = []
    for key, (*fold, pending) in kept.items():
        if key in seen:
            pending = sorted(seen[key].values())
        ready = _closed(pending, watermark)
        fold, pending = _follow(tuple(fold), pending[:ready]), pending[ready:]
        kept[key] = [*fold, pending]
        if key in seen:
            streak, since, _, attempts = _follow(fold, pending)
            out.append((*key, streak, since, attempts))
    _keep(state, kept, (pending[0][0] for *_, pending in kept.values() if pending))
    if out:
        yield pd.DataFrame(out, columns=["topic_id", "segment", "streak", "streak_since", "attempts"])


def stream_streak(stream: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Running low-novelty streak per (topic, segment), in order of weeks across micro-batches.

    ``stream``: topic_id, segment, week (sorts as text), low_novelty (null: not low) and
    ``event_time``, which rises with the week. Rows may come in any order within ``delay``:
    weeks ahead of the watermark wait in the state, those behind it are folded into four
    numbers, so the state holds the weeks of one delay at most. Keys share ``KEY_GROUPS`` state
    rows. Every new row writes the streak of its key over all weeks seen so far. A replayed week that still waits replaces its row; one
    already folded is ignored. A row without topic moves the watermark only.
    """
    weekly = stream.withWatermark(event_time, delay).select(
        _group("topic_id", "segment"),
        F.col("topic_id").cast("string").alias("topic_id"),
        "segment",
        event_time,
        F.unix_millis(event_time).alias("millis"),
        F.coalesce("week", F.lit("")).alias("week"),
        F.coalesce("low_novelty", F.lit(False)).alias("low_novelty"),
    )
    return weekly.groupBy("key_group").applyInPandasWithState(
        _streak, STREAK_OUT, KEPT, "update", GroupStateTimeout.EventTimeTimeout
    )


STOP_OUT = "topic_id string, step bigint, rolling_rate double"


def stream_saturation(
    stream: DataFrame, event_time: str, delay: str, window: int, minimum_queries: int, threshold: float
) -> DataFrame:
    """One stop row per topic once the rolling novelty rate falls below ``threshold``.

    ``stream``: topic_id, query_index, novelty_rate (null: 0) and ``event_time``; queries of
    a topic count in order of (event time, index). Rows may come in any order within
    ``delay``: those ahead of the watermark wait in the state, those behind it are folded
    into the last ``window`` rates. A stop is written when nothing can precede it any more,
    so it is never taken back; a stopped topic keeps a flag and waits for nothing. Topics share
    ``KEY_GROUPS`` state rows. A row without topic moves the watermark only.
    """

    def judge(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, watermark, fresh, out = _kept(state), state.getCurrentWatermarkMs(), {}, []
        for topic, millis, index, rate in _rows(batches, "topic_id", "millis", "query_index", "novelty_rate"):
            fresh.setdefault((topic,), []).append([millis, index, rate])
        for key in fresh:
            kept.setdefault(key, [[], 0, False, []])
        for key, (units, step, stopped, pending) in kept.items():
            if stopped:
                continue
            pending = sorted(pending + fresh.get(key, []))
            ready = _closed(pending, watermark)
            for _, _, rate in pending[:ready]:
                step += 1
                units = [*units, int(rate * 10000 + 0.5)][-window:]
                rolling = int(sum(units) / window + 0.5) / 10000
                if len(units) == window and step >= minimum_queries and rolling < threshold:
                    stopped = True
                    out.append((*key, step, rolling))
                    break
            kept[key] = [[], step, True, []] if stopped else [units, step, False, pending[ready:]]
        _keep(state, kept, (pending[0][0] for *_, pending in kept.values() if pending))
        if out:
            yield pd.DataFrame(out, columns=["topic_id", "step", "rolling_rate"])

    rates = stream.withWatermark(event_time, delay).select(
        _group("topic_id"),
        F.col("topic_id").cast("string").alias("topic_id"),
        event_time,
        F.unix_millis(event_time).alias("millis"),
        F.coalesce("query_index", F.lit(-1)).cast("bigint").alias("query_index"),
        F.coalesce("novelty_rate", F.lit(0.0)).alias("novelty_rate"),
    )
    return rates.groupBy("key_group").applyInPandasWithState(
        judge, STOP_OUT, KEPT, "update", GroupStateTimeout.EventTimeTimeout
    )


def split_late(path: str, event_time: str, delay: timedelta):
    """foreachBatch writer that parts rows behind the watermark from the rest.

    The watermark of a batch is the newest event time of all earlier batches less ``delay``;
    it lies beside the rows, one row a batch, so it outlives a restart, and a retried batch
    reads the mark of the batch before and overwrites its own folders. Rows go to
    ``rows/batch=.../late=false|true``. A row without event time is not late. The batch is
    scanned once: its own mark is taken from what was written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = spark.read.parquet(f"{path}/marks/batch={batch_id - 1}").head()[0] if batch_id else None
        limit = F.lit(mark - delay if mark else None).cast("timestamp")
        late = F.coalesce(F.col(event_time) < limit, F.lit(False))
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(f"{path}/rows/batch={batch_id}")
        newest = spark.read.schema(batch.schema).parquet(f"{path}/rows/batch={batch_id}").agg(F.max(event_time).alias("mark"))
        newest = newest.select(F.greatest("mark", F.lit(mark).cast("timestamp")).alias("mark"))
        newest.write.mode("overwrite").parquet(f"{path}/marks/batch={batch_id}")

    return write


def read_split(spark, path: str) -> DataFrame:
    """All rows ``split_late`` wrote, with ``batch`` and ``late``."""
    return spark.read.parquet(f"{path}/rows").withColumn("late", F.col("late").cast("boolean"))


def upsert_batch(path: str, keys: list[str], order: str):
    """foreachBatch writer: a replayed key replaces its earlier row.

    Every batch is one folder, so a retried batch overwrites itself; readers fold
    the folders with ``read_upserts``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        latest_per_key(batch, keys, [order]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_upserts(spark, path: str, keys: list[str]) -> DataFrame:
    """Current rows of a table written by ``upsert_batch``: the newest batch wins."""
    return latest_per_key(spark.read.parquet(path), keys, ["batch"]).drop("batch")


def stream_harvest(stream: DataFrame, dedupe_key: str) -> DataFrame:
    """Distinct (query, key) hits over all micro-batches.

    ``stream``: query_index, ``dedupe_key`` and further columns; a hit without query or key is
    left out. State is one row per pair, so a frequent key is spread over its queries. Of
    repeated pairs any row stays.
    """
    known = F.col("query_index").isNotNull() & F.col(dedupe_key).isNotNull()
    return stream.filter(known).dropDuplicates(["query_index", dedupe_key])


def harvest_batch(path: str, dedupe_key: str):
    """foreachBatch writer of ``stream_harvest``: new records, and what each query gained in the batch.

    A key counts for the query that returned it in the earliest micro-batch, there for the
    smallest query_index. Keys of earlier batches are read back from the written table (the
    key column, one row a key), so a restart repeats nothing; a retried batch overwrites its
    own folders.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        pairs = cut_lineage(batch)
        first = latest_per_key(pairs.withColumn("_first", -F.col("query_index")), [dedupe_key], ["_first"]).drop("_first")
        if batch_id:
            schema = StructType([pairs.schema[dedupe_key], StructField("batch", IntegerType())])
            known = batch.sparkSession.read.schema(schema).parquet(f"{path}/records").filter(F.col("batch") < batch_id)
            first = first.join(known, dedupe_key, "left_anti")
        fresh = cut_lineage(first)
        fresh.write.mode("overwrite").parquet(f"{path}/records/batch={batch_id}")
        added = fresh.groupBy("query_index").agg(F.count(F.lit(1)).alias("records_added"))
        unique = pairs.groupBy("query_index").agg(F.count(F.lit(1)).alias("unique_returned"))
        gained = unique.join(added, "query_index", "left").na.fill(0, ["records_added"])
        gained.write.mode("overwrite").parquet(f"{path}/novelty/batch={batch_id}")

    return write


def read_harvest(spark, path: str) -> DataFrame:
    """One novelty row per query over all batches so far."""
    gained = spark.read.parquet(f"{path}/novelty").groupBy("query_index")
    return gained.agg(F.sum("unique_returned").alias("unique_returned"), F.sum("records_added").alias("records_added"))
