"""Runs registered queries on Spark and their SQL on DuckDB and compares all values."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(repr(value))
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (datetime.date,)):
        return value.isoformat()
    return value


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted([tuple(_cell(r[n]) for n in names) for r in df.collect()], key=repr)


def rows_of_duck(connection, sql):
    result = connection.execute(sql)
    names = [c[0] for c in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted([tuple(_cell(r[i]) for i in order) for r in result.fetchall()], key=repr)


def compare(spark, sf_dir, name, queries, checks, connection):
    """Returns (ok, message)."""
    start = time.time()
    names, rows = rows_of_spark(queries[name](spark, sf_dir))
    took = time.time() - start
    if name not in checks:
        return True, f"rows only: {len(rows)} rows, {took:.1f}s"
    start = time.time()
    expected_names, expected = rows_of_duck(connection, checks[name])
    sql_took = time.time() - start
    if names != expected_names:
        return False, f"columns {names} != {expected_names}"
    if rows != expected:
        different = [(a, b) for a, b in zip(rows, expected) if a != b][:3]
        types = [(n, type(a).__name__, type(b).__name__) for n, a, b in zip(names, rows[0], expected[0])] if rows and expected else []
        return False, f"{len(rows)} vs {len(expected)} rows, first differences {different}; types {[t for t in types if t[1] != t[2]]}"
    return True, f"{len(rows)} rows, spark {took:.1f}s, sql {sql_took:.1f}s"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from incident_signals.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    queries, checks = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:]
    connection = duck(sf)
    bad = 0
    for name in queries:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, message = compare(spark, sf, name, queries, checks, connection)
        except Exception as error:  # noqa: BLE001
            ok, message = False, f"{type(error).__name__}: {str(error)[:700]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, message, flush=True)
    print("failures:", bad)
