"""Run queries beside their SQL twins and compare all values. Usage: oracle_check.py [folder] [name..]"""

from __future__ import annotations

import os
import sys
import time
import traceback
from glob import glob

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        if glob(path):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def normal(value):
    """Values as comparable text: equal numbers are equal whatever their type."""
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float)):
        return repr(float(value) + 0.0)
    return str(value)


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def compare(spark, connection, folder, query, sql):
    """Empty text when the results agree, else what differs."""
    frame = query(spark, folder)
    got = normal_rows(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    want = normal_rows(names, cursor.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} vs {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}"
    for left, right in zip(got, want):
        if left != right:
            off = sum(1 for a, b in zip(got, want) if a != b)
            return f"{off} rows differ, first {str(left)[:600]} vs {str(right)[:600]}"
    return ""


def main():
    import __spark_entry__ as contract
    from tests.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session()
    connection = connect(folder)
    sql = contract.oracle_sql()
    failed = []
    for name, query in contract.queries().items():
        if (wanted and name not in wanted) or name not in sql:
            continue
        start = time.time()
        try:
            problem = compare(spark, connection, folder, query, sql[name])
        except Exception:
            problem = traceback.format_exc()[-1500:]
        took = time.time() - start
        print(f"{'FAIL' if problem else 'ok  '} {name} {took:.2f}s {problem}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
