import base64
import hashlib
import random
from collections import defaultdict

import duckdb
import pyarrow.parquet as pq
import pytest
from check_oracle import connect, rows_of
from pyarrow import fs as pafs

from corroborate.llm import jaccard_join as J
from corroborate.llm import positional_index as P
from corroborate.llm.queries import ORACLES, QUERIES
from corroborate.llm.warc_bundles import BundleReader, parse, read_bundles, record, write_bundles
from corroborate.session import scratch_path

from .conftest import ROWS, frame, plain_words, spaced_words

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    df = QUERIES[name](spark, SF)
    result = connect(SF).execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


# Seekable WARC bundles

PAGES = [
    (1, "http://a.example/x y\r\nz", "<p>é same</p>"),
    (2, None, "<p>é same</p>"),
    (3, "http://b.example/", None),
    (4, "http://b.example/", ""),
    (5, "http://c.example/", "x" * 700_000),
    (6, "http://c.example/", "WARC/1.1\r\n\r\n\r\n\r\n"),
    (6, "http://c.example/", "WARC/1.1\r\n\r\n\r\n\r\n"),
    (None, "http://d.example/", "<p>é same</p>"),
    (None, "http://d.example/", "only here"),
]


def test_bundles_round_trip(spark):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, payload long").repartition(2)
    path = scratch_path(spark, "warc-test")
    write_bundles(pages, path)
    got = read_bundles(spark, path, with_payload=True).collect()
    first = defaultdict(list)
    for page_id, _, html in PAGES:
        first[html or ""].append(page_id)
    want = []
    for page_id, _, html in PAGES:
        raw = (html or "").encode()
        least = min((p for p in first[html or ""] if p is not None), default=None)
        revisit = least is not None and page_id != least
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((page_id, len(raw), digest, "revisit" if revisit else "response", least if revisit else None, None if revisit else raw))
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert sorted(((r[0], r[1], r[2], r[3], r[4], None if r[5] is None else bytes(r[5])) for r in got), key=key) == sorted(want, key=key)
    some = read_bundles(spark, path, spark.createDataFrame([(5,), (6,), (99,)], "page_id long")).collect()
    assert sorted(r.page_id for r in some) == [5, 6, 6]


def test_frames_stand_alone_and_end_in_a_seek_table(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 20_000) for i in range(12)], "page_id long, url string, html string").coalesce(1)
    path = scratch_path(spark, "warc-frames")
    write_bundles(pages, path)
    files, base = pafs.FileSystem.from_uri(path)
    seen = 0
    for info in files.get_file_info(pafs.FileSelector(f"{base}/archives")):
        reader = BundleReader(files.open_input_file(info.path))
        whole = b"".join(reader.frame(i) for i in range(len(reader.sizes)))
        import zstandard

        # Plain tools read the archive from start to end, skipping the table.
        assert zstandard.ZstdDecompressor().stream_reader(files.open_input_stream(info.path, compression=None), read_across_frames=True).read() == whole
        seen += len(reader.sizes)
    assert seen >= 6


def test_damaged_payload_is_refused():
    raw = record(1, "http://a/", b"payload", None, False)
    assert parse(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        parse(raw.replace(b"payload", b"pay1oad"))


def test_no_pages(spark):
    path = scratch_path(spark, "warc-empty")
    write_bundles(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert read_bundles(spark, path).count() == 0


# Jaccard join


def components_by_hand(rows, width, num, den):
    """(n, component) of each row, from all pairs."""
    sets = []
    for _, text, *_ in rows:
        words = spaced_words(text)
        sets.append({tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))} if words else set())
    group = list(range(len(rows)))
    find = lambda i: i if group[i] == i else find(group[i])
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                group[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    return [(r[0], len(sets[i]), min((d for d in least[find(i)] if d is not None), default=None)) for i, r in enumerate(rows)]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v or 0) for v in r))


def compare(spark, rows, tmp_path, parts=3):
    path = str(tmp_path / "documents.parquet")
    frame(spark, rows).repartition(parts).write.parquet(path)
    got = J.similar_documents(spark.read.parquet(path)).select("doc_id", "n_shingles", "component_id").collect()
    assert ordered(map(tuple, got)) == ordered(components_by_hand(rows, 3, 90, 100))


def test_components_of_odd_rows(spark, tmp_path):
    compare(spark, ROWS, tmp_path)


@pytest.mark.parametrize(("small", "rounds"), [(32, 3), (2, 3), (2, 0)])
def test_components_of_near_copies(spark, tmp_path, monkeypatch, small, rounds):
    """Groups in which some pairs link and others do not, with hubs of their own."""
    monkeypatch.setattr(J, "SMALL_POSTING", small)
    monkeypatch.setattr(J, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(J, "SHARD_BYTES", 5000)
    rng = random.Random(10 * small + rounds)
    rows, shared = [], [f"common{i}" for i in range(40)]
    for g in range(4):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.randrange(60, 160))]
        for _ in range(14):
            words = list(base)
            for _ in range(rng.randrange(5)):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(50)}"
            if rng.random() < 0.3:
                words += shared
            rows.append((len(rows) * 7 % 101, " ".join(words), None, None, None))
    rng.shuffle(rows)
    compare(spark, rows, tmp_path)


def test_splits_that_change_between_scans(spark, tmp_path, monkeypatch):
    """The first scans read many files a task, the later one reads each file in a task of its own."""
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*words[: i % 4 * 30], f"edit{i}", *words[i % 4 * 30 + 1 :]]), None, None, None) for i in range(24)]
    path, real = str(tmp_path / "documents.parquet"), J._sets
    frame(spark, rows).repartition(12).write.parquet(path)

    def split(*args):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        return real(*args)

    monkeypatch.setattr(J, "_sets", split)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        got = J.similar_documents(spark.read.parquet(path)).select("doc_id", "n_shingles", "component_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = components_by_hand(rows, 3, 90, 100)
    assert {c for *_, c in want} == {0} and ordered(map(tuple, got)) == ordered(want)


def test_rows_that_did_not_ask_are_refused(spark):
    path, schema = scratch_path(spark, "frequencies-test"), "doc_id long, text string, chunk int"
    asked = [(1, "a b c d", 0), (2, None, 1)]
    J._frequencies(spark.createDataFrame(asked, schema), 3, path)
    assert J._sets(spark.createDataFrame(asked, schema), 3, 90, 100, path).count() == 2
    for row in [(3, "x y z u", 0), (1, "a b c d", 1), (1, "a b c d", 2)]:
        with pytest.raises(Exception, match="differ from those that asked|has no frequencies"):
            J._sets(spark.createDataFrame([row], schema), 3, 90, 100, path).collect()


def test_no_documents(empty):
    assert J.similar_documents(empty).count() == 0


def test_large_group_is_not_paired(spark, tmp_path, monkeypatch):
    """300 near copies of one text cost a few comparisons a member."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        words = list(base)
        words[rng.randrange(200)] = f"edit{i}"
        rows.append((i, " ".join(words), None, None, None))
    path = str(tmp_path / "documents.parquet")
    frame(spark, rows).write.parquet(path)
    counted, real = [], J._overlaps

    def count(pairs, segments):
        counted.append(pairs.count())
        return real(pairs, segments)

    monkeypatch.setattr(J, "_overlaps", count)
    got = J.similar_documents(spark.read.parquet(path)).collect()
    assert {r.component_id for r in got} == {0}
    assert sum(counted) < 20 * 300


# Positional index

ITEMS = [
    (1, " ".join(f"q{i}" for i in range(20))),
    (2, "Short ITEM here"),
    (3, None),
    (4, "..."),
    (5, " ".join(f"q{i}" for i in range(5, 20)) + " end"),
    (5, "Short item here"),
    (None, "the the the the the the the the the the the the the the the"),
    (7, "absent words never seen"),
]
TEXTS = [
    (1, "x " * 30 + ITEMS[0][1] + " y" * 30, None, None, None),
    (2, "a short, ITEM: here; short item here", None, None, None),
    (2, "a short, ITEM: here; short item here", None, None, None),
    (2, "another text under the same id short item", None, None, None),
    (3, "the " * 200, None, None, None),
    (None, " ".join(f"q{i}" for i in range(13)), None, None, None),
    (None, None, None, None, None),
    (4, "", None, None, None),
    (5, ("filler " * 500) + ITEMS[0][1][:60], None, None, None),
    (6, "É short item here éa", None, None, None),
]


def contamination_by_hand(texts, items):
    out = []
    windows = []
    for item_id, text in items:
        words = plain_words(text)
        k = min(13, len(words))
        windows += [(item_id, words[i : i + k]) for i in range(len(words) - k + 1)] if words else []
    for doc_id, text, *_ in texts:
        words, hit, found = plain_words(text), set(), set()
        for item_id, window in windows:
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(item_id)
        names = ",".join(sorted(str(i) for i in found))
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


def test_contamination(spark):
    items = spark.createDataFrame([(i, t) for i, t in ITEMS if i is not None], "item_id long, text string")
    got = P.find_contamination(frame(spark, TEXTS), items).drop("text_key").collect()
    assert ordered(map(tuple, got)) == ordered(contamination_by_hand(TEXTS, [i for i in ITEMS if i[0] is not None]))


def test_contamination_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(P, "BROADCAST_ROWS", -1)
    items = spark.createDataFrame([(i, t) for i, t in ITEMS if i is not None], "item_id long, text string")
    got = P.find_contamination(frame(spark, TEXTS), items).drop("text_key").collect()
    assert ordered(map(tuple, got)) == ordered(contamination_by_hand(TEXTS, [i for i in ITEMS if i[0] is not None]))


def test_contamination_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in P.find_contamination(docs, none).collect()} == {0}
    assert P.find_contamination(empty, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_contamination_is_native(spark, docs):
    items = spark.createDataFrame([(1, "quick brown fox")], "item_id long, text string")
    plan = P.find_contamination(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_proximity(spark):
    rows = P.keyed(spark.createDataFrame([(1, "alpha x x beta"), (2, "alpha beta"), (3, "alpha x x x x x beta"), (4, "beta alpha")], "doc_id long, text string"))
    distinct, _ = P.phrases(spark.createDataFrame([(1, "alpha beta")], "item_id long, text string"))
    chosen = P.anchors(rows, distinct)
    got = {(r.doc_id, r.gap) for r in P.proximity_matches(P.build_index(rows, chosen), chosen, 2).collect()}
    assert got == {(1, 2), (2, 0), (4, 2)}


# Pipeline


def test_pipeline_keeps_what_each_stage_should(spark, tmp_path):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {}
    for name, stage in C.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    table = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    assert len(rows["language"]) == sum(any(c.isalpha() for c in r["text"] or "") for r in table)
    before = [(r.doc_id, r.text) for r in rows["toxicity"]]
    parts = components_by_hand(before, 5, 80, 100)
    assert {r.doc_id for r in rows["near_copies"]} == {c for _, n, c in parts if n} | {d for d, n, _ in parts if not n}
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    dirty = {r[0] for r in contamination_by_hand([(r.doc_id, r.text) for r in rows["near_copies"]], items) if r[-1]}
    assert {r.doc_id for r in rows["benchmark"]} == {r.doc_id for r in rows["near_copies"]} - dirty
    assert {r.doc_id for r in rows["packing"]} == {r.doc_id for r in rows["benchmark"]}


def test_stages_take_odd_rows(spark, docs, empty, tmp_path):
    import corpus_pipeline as C

    for k, start in enumerate((docs, empty)):
        now = start
        for name, stage in C.STAGES:
            stage(spark, now, SF).write.parquet(str(tmp_path / f"{name}{k}"))
            now = spark.read.parquet(str(tmp_path / f"{name}{k}"))
        assert k or now.count() > 0


def test_copies_with_clashing_columns_leave_one_row(spark, docs):
    import corpus_pipeline as C

    kept = C.drop_near_copies(spark, docs, SF).collect()
    assert sum(r.text == ROWS[0][1] for r in kept) == 1 and {r.text_key for r in kept} <= {None, "b"}


def test_counting_one_shard_takes_little_memory():
    import tracemalloc

    import numpy as np
    import pandas as pd

    from corroborate.llm import jaccard_join as J

    rng = np.random.default_rng(3)
    parts = np.array_split(rng.integers(0, 1 << J.KEY_BITS, J.SHARD_BYTES // 6, dtype=np.uint64), 16)
    parts = [np.unique(p) for p in parts]
    counts = [J.zlib.compress(np.ones(len(p), "<u2").tobytes(), 1) for p in parts]
    group = pd.DataFrame({"chunk": range(16), "keys": [J._pack(p) for p in parts], "counts": counts})
    tracemalloc.start()
    out = J._count((0,), group)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Two of these run beside each other in an executor whose heap takes most of its memory.
    assert len(out) == 16 and peak < 160e6
