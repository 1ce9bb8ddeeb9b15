"""Compare registered queries with their SQL in DuckDB: python tests/parity.py [sf] [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for table in BASE:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return repr(float(value))
    if isinstance(value, int):
        return value
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(data, key=repr)


def compare(spark, connection, sf_dir, name, function, sql):
    """None where both agree, else a description of the first difference."""
    df = function(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(sql)
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} / {want[0]}"
    if len(got[1]) != len(want[1]):
        extra = sorted(set(got[1]) - set(want[1]), key=repr)[:2]
        missing = sorted(set(want[1]) - set(got[1]), key=repr)[:2]
        return f"rows {len(got[1])} / {len(want[1])}; only Spark {extra}; only SQL {missing}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"first difference\n   {a}\n   {b}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from fundtrace.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    chosen = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, connection = local_session(8), connect(sf_dir)
    sql, bad = entry.oracle_sql(), 0
    for name, function in entry.queries().items():
        if chosen and not any(name.startswith(c) for c in chosen):
            continue
        begun = time.time()
        try:
            if name not in sql:
                count = function(spark, sf_dir).count()
                print(f"rows {name}: {count} ({time.time() - begun:.1f}s)", flush=True)
                continue
            problem = compare(spark, connection, sf_dir, name, function, sql[name])
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'BAD ' if problem else 'ok  '} {name} ({time.time() - begun:.1f}s) {problem or ''}", flush=True)
    print("differences:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
