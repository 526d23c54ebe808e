"""Runs a registered query on Spark and its SQL on DuckDB and compares rows, column names, types and values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return ("0null",)
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, float):
        return ("float", "nan" if math.isnan(value) else round(value, 9))
    return (type(value).__name__, str(value))


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, entry, sf_dir: str, allow_empty: bool = False):
    """(ok, detail) for one registered query."""
    started = time.time()
    df = entry.run(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - started
    if entry.sql is None:
        return bool(rows), f"rows-only {len(rows)} rows {spent:.1f}s"
    started = time.time()
    result = con.execute(entry.sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    took = f"{len(rows)} rows spark {spent:.1f}s duckdb {time.time() - started:.1f}s"
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    ours, theirs = _rows(df.columns, rows), _rows(names, expected)
    if not theirs and not allow_empty:
        return False, f"the SQL returns no row; {took}"
    if ours == theirs:
        return True, took
    extra = [r for r in ours if r not in set(theirs)][:3]
    missing = [r for r in theirs if r not in set(ours)][:3]
    return False, f"{took} vs {len(theirs)}\n   ours only {extra}\n   sql only  {missing}"


def main(argv):
    from normlake.plans import load_all
    from normlake.plans.registry import REGISTRY
    from normlake.session import local_session

    sf_dir, wanted = argv[0], argv[1:]
    load_all()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, entry in REGISTRY.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, detail = compare(spark, con, entry, sf_dir)
        except Exception as exc:  # report every query, then fail
            ok, detail = False, f"{type(exc).__name__}: {str(exc)[:900]}"
        failed += not ok
        print(("ok   " if ok else "FAIL ") + name, detail, flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
