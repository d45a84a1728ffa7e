import datetime as dt
import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from corroborate.sources import readers, sinks
from corroborate.streaming import incremental as I


def record(i, **extra):
    return {"record_id": f"r{i}", "title": f"Title {i}", "year": 2020, "abstract": "text", "citations": i, **extra}


def test_read_evidence_skips_manifest_and_side_files(spark, tmp_path):
    (tmp_path / "AA-01.json").write_text(json.dumps({"mechanism_id": "AA-01", "records": [record(1), record(2)]}, indent=2))
    (tmp_path / "AA-01.regression.json").write_text(json.dumps({"mechanism_id": "AA-01", "records": [record(3)]}))
    (tmp_path / "manifest.json").write_text(json.dumps({"source": "x"}))
    assert readers.read_evidence(spark, str(tmp_path)).count() == 2
    assert readers.read_evidence(spark, str(tmp_path), include_side_files=True).count() == 3


def test_read_observations_nested(spark, tmp_path):
    for topic in ("ZE-07", "ZE-08"):
        (tmp_path / topic).mkdir()
        (tmp_path / topic / "records.json").write_text(json.dumps({"mechanism_id": topic, "records": [{"record_id": "o1", "observation": "seen"}]}))
        (tmp_path / topic / "other.json").write_text("{}")
    assert sorted(r.topic_id for r in readers.read_observations(spark, str(tmp_path)).collect()) == ["ZE-07", "ZE-08"]


def test_read_registry_and_artifacts(spark, tmp_path):
    full, seed = tmp_path / "full", tmp_path / "seed"
    full.mkdir(), seed.mkdir()
    (full / "A.json").write_text(json.dumps({"id": "A", "parent": "p"}))
    (full / "x.schema.json").write_text(json.dumps({"id": "schema"}))
    (seed / "B.json").write_text(json.dumps({"id": "B", "parent": "p"}))
    rows = readers.read_registry(spark, str(full), str(seed), "id string, parent string, _corrupt string").collect()
    assert {(r.id, r.kind) for r in rows if r.id != "schema"} == {("A", "full"), ("B", "stub")}
    assert [r.id for r in readers.read_artifacts(spark, str(full), "id string, parent string, _corrupt string").collect()] == ["A"]


@pytest.mark.parametrize("fmt,body", [
    ("csv", 'metric,category,value,unit,notes\n"a, ""b""",c,1.5,%,\n'),
    ("json", json.dumps([{"metric": 'a, "b"', "category": "c", "value": 1.5, "unit": "%"}])),
    ("md", '# t\n\n| metric | category | value | unit | notes |\n|---|---|---|---|---|\n| a, "b" | c | 1.5 | % | |\n\n| other | table |\n'),
])
def test_report_formats_agree(spark, tmp_path, fmt, body):
    path = tmp_path / f"r.{fmt}"
    path.write_text(body)
    good, bad = readers.normalise_metric_rows(readers.read_report(spark, str(path), fmt))
    assert [tuple(r) for r in good.select("metric", "category", "value", "unit", "notes").collect()] == [('a, "b"', "c", 1.5, "%", None)]
    assert bad.count() == 0


def test_file_inventory(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text("12345")
    (tmp_path / "y.txt").write_text("1")
    rows = readers.file_inventory(spark, str(tmp_path)).collect()
    assert sorted(r.bytes for r in rows) == [1, 5]


def test_write_scoped_refuses_a_broken_grid(spark, tmp_path):
    path = str(tmp_path / "m")
    cells = spark.createDataFrame([("r1", "s1", 1, "v1"), ("r2", "s1", 1, "v1")], "row string, segment string, score int, version string")
    cells.write.partitionBy("row").parquet(path)
    expected = spark.createDataFrame([("r1", "s1"), ("r2", "s1"), ("r2", "s2")], "row string, segment string")
    with pytest.raises(ValueError):
        sinks.write_scoped(cells.filter("row = 'r1'"), path, expected, "v1")
    sinks.write_scoped(cells.filter("row = 'r1'").withColumn("score", F.lit(7)), path, expected.filter("segment = 's1'"), "v1")
    assert {(r.row, r.score) for r in spark.read.parquet(path).collect()} == {("r1", 7), ("r2", 1)}


def run_batches(spark, tmp_path, parts, schema, build, keys):
    """Land the parts one after the other, a restart between them, and read the upserted result."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = build(spark.readStream.schema(schema).parquet(src).withColumn("at", F.to_timestamp("at")))
        run = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "log"))
        run.foreachBatch(I.upsert_batch(out, keys, keys[0])).trigger(availableNow=True).start().awaitTermination()
    return [tuple(r) for r in I.read_upserts(spark, out, keys).collect()]


STREAK = "topic_id string, segment string, week string, low_novelty boolean, at string"


def streak(stream):
    return I.stream_streak(stream, "at", "25 days")


def test_streak_over_several_batches(spark, tmp_path):
    weeks = [("t", "s", w := f"2024-01-{d:02d}", low, w) for d, low in [(1, True), (8, False), (15, True), (22, True)]]
    parts = [[weeks[3], weeks[1]], [weeks[2], weeks[0]], [weeks[3]]]
    got = run_batches(spark, tmp_path, parts, STREAK, streak, ["topic_id", "segment"])
    assert got == [("t", "s", 2, "2024-01-15", 4)]


def test_streak_replaces_waiting_weeks_and_drops_late_ones(spark, tmp_path):
    def row(week, low):
        return ("t", "s", week, low, week)

    parts = [[row("2024-01-01", True), row("2024-01-08", True)], [row("2024-01-08", None)], [(None, None, None, None, "2024-03-01")]]
    parts += [[row("2024-01-02", True)], [row("2024-03-04", True)]]
    got = run_batches(spark, tmp_path, parts, STREAK, streak, ["topic_id", "segment"])
    assert got == [("t", "s", 1, "2024-03-04", 3)]


def test_saturation_waits_for_earlier_queries(spark, tmp_path):
    rates = [0.9, 0.5, 0.1, 0.0, 0.0, 0.9]
    rows = [("t", i, r, f"2024-01-{i + 1:02d}") for i, r in enumerate(rates)]
    closing = [(None, None, None, "2024-03-01")]
    parts = [[rows[i] for i in (3, 2, 4)], [rows[i] for i in (1, 5, 0)], closing, [("t", 6, 0.0, "2024-03-02")]]
    build = lambda s: I.stream_saturation(s, "at", "10 days", 2, 3, 0.2)
    got = run_batches(spark, tmp_path, parts, "topic_id string, query_index bigint, novelty_rate double, at string", build, ["topic_id"])
    assert got == [("t", 4, 0.05)]


def test_freshness_expires_and_comes_back(spark, tmp_path):
    def run(parts, name):
        build = lambda s: I.stream_freshness(s.withColumnRenamed("at", "ts"), "ts", "1 hour")
        got = run_batches(spark, tmp_path / name, parts, "source_id string, status string, at string", build, ["source_id"])
        return {r[0]: (str(r[1]), r[2]) for r in got}

    first = [("a", "down", "2024-01-01 00:00:00"), ("a", "up", "2024-01-01 00:00:00"), ("b", None, "2024-01-01 06:00:00")]
    closing = [(None, None, "2024-01-01 13:00:00")]
    assert run([first, closing], "x") == {"a": ("2024-01-01 00:00:00", "unknown"), "b": ("2024-01-01 06:00:00", "unknown")}
    later = [("a", "down", "2024-01-01 14:00:00"), ("b", "up", "2024-01-01 05:00:00")]
    assert run([first, closing, later], "y")["a"] == ("2024-01-01 14:00:00", "down")


def test_late_rows_go_aside_and_a_retry_changes_nothing(spark, tmp_path):
    write = I.split_late(str(tmp_path), "at", timedelta(hours=1))
    at = lambda hour: dt.datetime(2024, 1, 1, hour)
    batches = [[(1, at(10)), (2, None)], [(3, at(8)), (4, at(9)), (5, at(12))], [(6, at(9)), (7, None)], [(8, at(11))]]
    for n in (0, 1, 1, 2, 3):
        write(spark.createDataFrame(batches[n], "id int, at timestamp"), n)
    got = {r.id: r.late for r in I.read_split(spark, str(tmp_path)).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: False, 6: True, 7: False, 8: False}


def test_harvest_credits_the_first_query_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "query_index bigint, key string, title string"
    parts = [[(2, "a", "x"), (1, "a", None), (1, "a", "y"), (2, None, "z")], [(0, "a", "x"), (2, "b", "x"), (2, "a", "x")], [(None, "c", "x"), (2, "c", "x")]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        run = I.stream_harvest(spark.readStream.schema(schema).parquet(src), "key").writeStream
        run = run.option("checkpointLocation", str(tmp_path / "log")).foreachBatch(I.harvest_batch(out, "key"))
        run.trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in I.read_harvest(spark, out).collect())
    assert got == [(0, 1, 0), (1, 1, 1), (2, 3, 2)]
    assert sorted(r.key for r in spark.read.parquet(f"{out}/records").collect()) == ["a", "b", "c"]


def test_keys_of_one_group_keep_their_own_streaks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "KEY_GROUPS", 1)
    row = lambda key, week, low: (key, None, week, low, week)
    parts = [[row("a", "2024-01-01", True), row("b", "2024-01-01", False)], [row("a", "2024-01-08", True), (None, None, None, None, "2024-03-01")], [row("b", "2024-03-02", True)]]
    got = run_batches(spark, tmp_path, parts, STREAK, streak, ["topic_id", "segment"])
    assert sorted(got) == [("a", None, 2, "2024-01-01", 2), ("b", None, 1, "2024-03-02", 2)]


def test_topics_of_one_group_stop_on_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "KEY_GROUPS", 1)
    rows = [(k, i, r, f"2024-01-{i + 1:02d}") for k, rates in (("a", [0.9, 0.1, 0.0, 0.0]), ("b", [0.9, 0.9, 0.0, 0.0])) for i, r in enumerate(rates)]
    build = lambda s: I.stream_saturation(s, "at", "10 days", 2, 3, 0.2)
    parts = [rows[4:] + rows[:2], rows[2:4], [(None, None, None, "2024-03-01")]]
    got = run_batches(spark, tmp_path, parts, "topic_id string, query_index bigint, novelty_rate double, at string", build, ["topic_id"])
    assert sorted(got) == [("a", 3, 0.05), ("b", 4, 0.0)]
