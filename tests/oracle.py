"""Compare registered queries with their SQL in DuckDB, the way the driver does: order-insensitive."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    return repr(value)


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """None when both agree, otherwise what differs; with the Spark seconds."""
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    kinds = dict(df.dtypes)
    if sql is None:
        return None, seconds, len(got)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    left_cols, left = _sorted_rows(df.columns, got)
    right_cols, right = _sorted_rows(names, want)
    if left_cols != right_cols:
        return f"columns {left_cols} != {right_cols}", seconds, len(got)
    duck = dict(con.execute(f"DESCRIBE {sql}").fetchall()[i][:2] for i in range(len(names)))
    alias = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    odd = {c: (kinds[c], duck[c]) for c in left_cols if c in duck and alias.get(kinds[c]) and alias[kinds[c]] != duck[c]}
    if left != right:
        left_set, right_set = set(left), set(right)
        extra = [r for r in left if r not in right_set][:2]
        missing = [r for r in right if r not in left_set][:2]
        return f"rows {len(left)} vs {len(right)}; spark only {extra}; sql only {missing}", seconds, len(got)
    if odd:
        return f"types {odd}", seconds, len(got)
    return None, seconds, len(got)


if __name__ == "__main__":
    import sys

    sys.path.insert(0, "/root/repo")
    from steepgrid.session import get_spark
    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = get_spark(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            problem, seconds, n = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            problem, seconds, n = f"{type(error).__name__}: {str(error)[:600]}", 0.0, 0
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:28s} rows={n:7d} {seconds:6.2f}s {'' if sqls.get(name) else '(rows only)'} {problem or ''}", flush=True)
    print("bad:", bad)
