"""Compares queries with their SQL twins on one folder of tables.

    python -m tests.check [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def cell(value: object) -> object:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 9)
    return str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda at: columns[at])
    return sorted((tuple(cell(row[at]) for at in order) for row in rows), key=repr)


def spark_rows(frame: DataFrame) -> tuple[list[str], list[tuple]]:
    return sorted(frame.columns), rows_of(frame.columns, [tuple(row) for row in frame.collect()])


def sql_rows(connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    result = connection.execute(sql)
    columns = [column[0] for column in result.description]
    return sorted(columns), rows_of(columns, result.fetchall())


def difference(name: str, frame: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between a query and its twin, or None."""
    columns, rows = spark_rows(frame)
    twin_columns, twin_rows = sql_rows(connection, sql)
    if columns != twin_columns:
        return f"{name}: columns {columns} and {twin_columns}"
    if rows != twin_rows:
        only = [row for row in rows if row not in set(twin_rows)][:2]
        twin_only = [row for row in twin_rows if row not in set(rows)][:2]
        return f"{name}: {len(rows)} and {len(twin_rows)} rows; {only!r:.900} and {twin_only!r:.900}"
    return None if rows else f"{name}: no rows"


def main() -> None:
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark, connection = session(), database(folder)
    spark.sparkContext.setLogLevel("ERROR")
    queries, twins = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in sys.argv[2:] or queries:
        start = time.perf_counter()
        try:
            fault = difference(name, queries[name](spark, folder), connection, twins[name])
        except Exception as error:
            fault = f"{name}: {type(error).__name__}: {str(error)[:1500]}"
        failed += fault is not None
        print(f"{'DIFF' if fault else 'ok  '} {name} {time.perf_counter() - start:.2f}s {fault or ''}", flush=True)
    print(f"{failed} of {len(sys.argv[2:] or queries)} differ")


if __name__ == "__main__":
    main()
