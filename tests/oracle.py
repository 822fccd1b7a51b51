"""Compares registered queries with their SQL on DuckDB.  Usable as a script: ``oracle.py [sf] [query ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
TESTDATA = Path("/root/testdata")


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in Path(directory).glob("*.parquet"):
        connection.sql(f"create view {path.stem} as select * from '{path}'")
    return connection


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    return value


def _rows(table, columns) -> Counter:
    lists = [table.column(c).to_pylist() for c in columns]
    return Counter(tuple(_plain(v) for v in row) for row in zip(*lists))


def compare(df, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences between the frame and the SQL result; empty when they agree."""
    expected = connection.sql(sql).to_arrow_table()
    actual = df.toArrow()
    columns = sorted(expected.column_names)
    if columns != sorted(actual.column_names):
        return [f"columns {sorted(actual.column_names)} instead of {columns}"]
    problems = []
    for column in columns:
        ours, theirs = (str(t.schema.field(column).type) for t in (actual, expected))
        ours, theirs = ours.replace("large_string", "string"), theirs.replace("large_string", "string")
        if ours != theirs:
            problems.append(f"type of {column}: {ours} instead of {theirs}")
    left, right = _rows(actual, columns), _rows(expected, columns)
    if left != right:
        extra, missing = list((left - right).items())[:3], list((right - left).items())[:3]
        problems.append(f"{actual.num_rows} rows instead of {expected.num_rows}; extra {extra}, missing {missing}")
    return problems


def main() -> None:
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry
    from pipekit.session import build_session

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    directory = str(TESTDATA / f"sf{scale}")
    connection = connect(directory)
    chosen = sys.argv[2:] or list(entry.queries())
    for name in chosen:
        start = time.time()
        try:
            df = entry.queries()[name](spark, directory)
            sql = entry.oracle_sql().get(name)
            verdict = compare(df, connection, sql) if sql else [f"no SQL, {df.count()} rows"]
        except Exception as error:  # noqa: BLE001 - shown and skipped
            verdict = [f"{type(error).__name__}: {str(error)[:600]}"]
        print(f"{name:28s} {time.time() - start:6.2f}s {'ok' if not verdict else verdict}", flush=True)


if __name__ == "__main__":
    main()
