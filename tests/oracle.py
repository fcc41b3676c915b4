"""Compare registered queries with their DuckDB counterparts on one folder of test tables."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def cell(v):
        return "NaN" if isinstance(v, float) and math.isnan(v) else v
    return sorted(tuple(cell(row[i]) for i in order) for row in rows), [columns[i] for i in order]


def compare(spark, con, folder, build, sql) -> str | None:
    """None when both give the same rows, else what differs."""
    result = con.execute(sql)
    expected, names = normal(result.fetchall(), [d[0] for d in result.description])
    df = build(spark, folder)
    found, columns = normal([tuple(r) for r in df.collect()], df.columns)
    if columns != names:
        return f"columns {columns} instead of {names}"
    types = {str(d[1]) for d in result.description}
    if len(found) != len(expected):
        return f"{len(found)} rows instead of {len(expected)}"
    wrong = [(a, b) for a, b in zip(found, expected) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    return f"{len(wrong)} rows differ, first {wrong[0]} ({types})" if wrong else None


if __name__ == "__main__":
    import sys

    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(folder), entry.oracle_sql()
    for name, build in entry.queries().items():
        if only and name not in only:
            continue
        began = time.time()
        try:
            problem = compare(spark, con, folder, build, sqls[name]) if name in sqls else f"rows only: {build(spark, folder).count()}"
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if problem is None else 'DIFF'} {name} {time.time() - began:.2f}s {problem or ''}", flush=True)
