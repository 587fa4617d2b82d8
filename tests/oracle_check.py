"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

    python tests/oracle_check.py SF_DIR [name ...] [--module plans_module ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def make_spark():
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master("local[8]").appName("check")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if v == 0:
            v = 0.0
        return f"{v:.10g}" if v != int(v) or abs(v) > 1e15 else str(int(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}={norm(x)}" for k, x in v.items()) + "}"
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    c1, r1 = rows_of(df.columns, got)
    if sql is None:
        return "ROWS", len(r1), t1 - t0, 0.0, ""
    con.execute(sql)
    cols = [d[0] for d in con.description]
    want = con.fetchall()
    t2 = time.time()
    c2, r2 = rows_of(cols, want)
    if c1 != c2:
        return "COLS", len(r1), t1 - t0, t2 - t1, f"{c1} vs {c2}"
    if r1 == r2:
        return "OK", len(r1), t1 - t0, t2 - t1, ""
    s1, s2 = set(r1), set(r2)
    a = [r for r in r1 if r not in s2][:3]
    b = [r for r in r2 if r not in s1][:3]
    return "DIFF", len(r1), t1 - t0, t2 - t1, f"{len(r1)} vs {len(r2)}\n  cols {c1}\n  spark {a}\n  duck  {b}"


def main():
    import __spark_entry__ as E

    sf = sys.argv[1]
    names = sys.argv[2:]
    spark = make_spark()
    con = duck(sf)
    qs, orc = E.queries(), E.oracle_sql()
    pick = [n for n in qs if not names or n in names or any(n2.startswith("@") and qs[n].__module__ and getattr(qs[n], "section", "") == n2[1:] for n2 in names)]
    bad = 0
    for n in pick:
        try:
            st, k, a, b, msg = compare(spark, con, qs[n], orc.get(n), sf)
        except Exception as exc:  # noqa: BLE001
            st, k, a, b, msg = "ERR", 0, 0.0, 0.0, f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += st not in ("OK", "ROWS")
        print(f"{st:5s} {n:32s} rows={k:<7d} spark={a:.2f}s duck={b:.2f}s {msg}", flush=True)
    print(f"{len(pick)} queries, {bad} bad")
    spark.stop()


if __name__ == "__main__":
    main()
