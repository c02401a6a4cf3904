"""Run every registered query and compare it with its DuckDB text: python tests/check.py [sf] [name ...]"""

from __future__ import annotations

import glob
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from cohortflow.session import build_session  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in records)


def compare(spark, con, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    got = rows([tuple(x) for x in df.collect()], df.columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(got), None, []
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    if sorted(cols) != sorted(df.columns):
        return len(got), False, [("columns", sorted(cols), sorted(df.columns))]
    want = rows(cur.fetchall(), cols)
    return len(got), got == want, [(w, g) for w, g in zip(want, got) if w != g][:2] or [(len(want), len(got))]


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = []
    for name in sys.argv[2:] or list(entry.queries()):
        start = time.time()
        try:
            n, ok, diff = compare(spark, con, sf_dir, name)
        except Exception as e:  # report and go on with the next query
            n, ok, diff = -1, False, [str(e)[:600]]
        state = {True: "ok", False: "DIFF", None: "rows"}[ok]
        print(f"{name:28s} {state:5s} {n:7d} {time.time() - start:6.2f}s", flush=True)
        if ok is False:
            bad.append(name)
            print("   ", diff, flush=True)
    print("failed:", bad)
