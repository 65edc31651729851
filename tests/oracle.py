"""Runs registered queries against their SQL on the same parquet tables.

usage: python tests/oracle.py SF_DIR [name ...]
"""

import datetime
import decimal
import glob
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if isinstance(value, float) and value != value:
        return "nan"
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(name, fn, sql, spark, con, sf_dir):
    df = fn(spark, sf_dir)
    got_cols, got = normalise(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = normalise([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    off = [(g, w) for g, w in zip(got, want) if g != w or list(map(type, g)) != list(map(type, w))]
    if off:
        g, w = off[0]
        cells = [(c, a, b) for c, a, b in zip(got_cols, g, w) if a != b or type(a) is not type(b)]
        return f"{len(off)} of {len(got)} rows differ, first: {cells[:6]}"
    return None if got else "no rows"


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        began = time.time()
        try:
            if name in oracles:
                verdict = compare(name, queries[name], oracles[name], spark, con, sf_dir)
            else:
                rows = queries[name](spark, sf_dir).count()
                verdict = f"rows only: {rows}" if rows else "no rows"
        except Exception as error:                                    # noqa: BLE001
            verdict = f"{type(error).__name__}: {str(error)[:900]}"
        bad += verdict is not None and not verdict.startswith("rows only")
        print(f"{name:28s} {time.time() - began:6.1f}s  {verdict or 'ok'}", flush=True)
    print("failing:", bad)


if __name__ == "__main__":
    main()
