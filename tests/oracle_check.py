"""Compare every registered query with its plain-SQL statement in DuckDB.

    python tests/oracle_check.py [data directory] [query name ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, datetime.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted(tuple(str(cell(r[i])) for i in order) for r in rows)
    return [columns[i] for i in order], lines


def compare(spark, con, name, build, statement, sf_dir) -> str:
    got = build(spark, sf_dir)
    mine = canonical(got.columns, [tuple(r) for r in got.collect()])
    if statement is None:
        return f"rows only ({len(mine[1])})"
    cur = con.execute(statement)
    theirs = canonical([c[0] for c in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"MISMATCH columns {mine[0]} / {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"MISMATCH rows {len(mine[1])} / {len(theirs[1])}"
    bad = [(a, b) for a, b in zip(*(x[1] for x in (mine, theirs))) if a != b]
    if bad:
        return f"MISMATCH {len(bad)} of {len(mine[1])}, first {bad[0]}"
    return f"ok ({len(mine[1])} rows)"


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con, statements, failures = connect(sf_dir), entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        t = time.time()
        try:
            result = compare(spark, con, name, build, statements.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            result = "ERROR " + str(e).split("\n\nJVM")[0][:600]
        failures += result.startswith(("MISMATCH", "ERROR"))
        print(f"{name:32s} {time.time() - t:6.1f}s  {result}", flush=True)
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
