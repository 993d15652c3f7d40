"""Runs queries against their SQL twins: ``python tests/compare.py [folder] [name prefix ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from sundown.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def normal(value: object) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(round(value, 9))
    return str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(row[i]) for i in order) for row in rows)


LIKE = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "date": "DATE"}


def unlike_types(ours: dict[str, str], theirs: dict[str, str]) -> dict[str, tuple[str, str]]:
    return {c: (t, theirs[c]) for c, t in ours.items() if LIKE.get(t, t) != theirs[c]}


def compare(spark, connection, name: str, folder: str) -> tuple[bool, str, float]:
    started = time.time()
    df = entry.queries()[name](spark, folder)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(ours[1]) > 0, f"rows only: {len(ours[1])}", took
    cursor = connection.execute(sql)
    theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if ours[0] != theirs[0]:
        return False, f"columns {ours[0]} != {theirs[0]}", took
    if ours[1] != theirs[1]:
        a, b = set(ours[1]), set(theirs[1])
        return False, f"{len(ours[1])} vs {len(theirs[1])} rows; ours only {sorted(a - b)[:3]}; theirs only {sorted(b - a)[:3]}", took
    odd = unlike_types(dict(df.dtypes), {d[0]: str(d[1]) for d in cursor.description})
    return True, f"{len(ours[1])} rows{' TYPES ' + str(odd) if odd else ''}", took


def main() -> int:
    arguments = sys.argv[1:]
    folder = arguments[0] if arguments else "/root/testdata/sf0.01"
    prefixes = tuple(arguments[1:])
    spark, connection = local_session(), connect(folder)
    failed = 0
    for name in entry.queries():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            good, note, took = compare(spark, connection, name, folder)
        except Exception as error:  # noqa: BLE001
            good, note, took = False, f"{type(error).__name__}: {str(error)[:700]}", 0.0
        failed += not good
        print(f"{'ok  ' if good else 'FAIL'} {name} {took:.2f}s {note}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
