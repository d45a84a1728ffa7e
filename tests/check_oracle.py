"""Run registered queries against their DuckDB oracle and report differences.

python tests/check_oracle.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(str(canonical(v)) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def spark_session(cores: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corroborate")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args.names or any(n.startswith(p) for p in args.names)]
    spark = spark_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, args.sf)
            got = rows_of(df.columns, df.collect())
            took = time.time() - start
            if name not in oracles:
                print(f"ROWS  {name} rows={len(got)} {took:.1f}s", flush=True)
                continue
            mid = time.time()
            result = con.execute(oracles[name])
            columns = [d[0] for d in result.description]
            want = rows_of(columns, result.fetchall())
            oracle = time.time() - mid
            same_names = sorted(columns) == sorted(df.columns)
            ok = same_names and got == want
            kinds = "" if ok else f" names={same_names} got={len(got)} want={len(want)}"
            print(f"{'OK   ' if ok else 'DIFF '} {name} rows={len(got)} {took:.1f}s oracle={oracle:.1f}s{kinds}", flush=True)
            if not ok:
                bad += 1
                print("   spark:", sorted(df.columns), [r for r in got if r not in set(want)][:3])
                print("   duck :", sorted(columns), [r for r in want if r not in set(got)][:3])
        except Exception as error:  # a broken query must not hide the others
            bad += 1
            print(f"FAIL  {name}: {type(error).__name__}: {str(error)[:6000]}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
