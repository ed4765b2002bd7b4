"""Runs a registered query and its SQL and compares the rows, whatever their order.

``python tests/oracle.py [sf dir] [query ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _cell(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (pd.Timestamp,)):
        return value.isoformat()
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    return value


def rows(columns, records) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(r[i]) for i in order) for r in records]
    return [columns[i] for i in order], sorted(cells, key=repr)


TIMES: dict[str, float] = {}


def compare(spark, connection, query, sql: str, sf_dir: str) -> tuple[str | None, int]:
    """A description of the first difference, or ``None``; and the number of rows."""
    start = time.time()
    df = query(spark, sf_dir)
    got_columns, got = rows(df.columns, [tuple(r) for r in df.collect()])
    TIMES["spark"] = time.time() - start
    result = connection.execute(sql)
    want_columns, want = rows([c[0] for c in result.description], result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}", len(got)
    types = {c[0]: str(c[1]) for c in result.description}
    for name, kind in df.dtypes:
        sql_kind = types[name].upper()
        if (kind == "bigint") != (sql_kind in ("BIGINT", "NUMBER") or sql_kind == "BIGINT"):
            return f"type of {name}: {kind} != {sql_kind}", len(got)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}", len(got)
    for a, b in zip(got, want):
        if a != b:
            return f"{got_columns}\n  spark {a}\n  sql   {b}", len(got)
    return None, len(got)


def main() -> int:
    from conftest import session

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark, connection = session(), connect(sf_dir)
    oracles = entry.oracle_sql()
    failed = 0
    for name in names:
        start = time.time()
        try:
            if name in oracles:
                problem, n = compare(spark, connection, entry.queries()[name], oracles[name], sf_dir)
            else:
                problem, n = None, len(entry.queries()[name](spark, sf_dir).collect())
        except Exception as error:
            problem, n = f"{type(error).__name__}: {str(error)[:1500]}", -1
        failed += problem is not None
        checked = "sql" if name in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok'} {name} {checked} rows={n} {time.time() - start:.2f}s (Spark {TIMES.get('spark', 0):.2f}s)", flush=True)
        if problem:
            print("  ", problem, flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
