"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

    python -m checks.compare [data_dir] [query ...]
"""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks import catalog
from shelflight.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def oracle(data_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = pathlib.Path(data_dir, f"{name}.parquet")
        if path.exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value: object) -> object:
    if value is None:
        return "\0null"
    if isinstance(value, float):
        return "\0nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def _rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def check(spark: SparkSession, connection: duckdb.DuckDBPyConnection, data_dir: str, name: str) -> str | None:
    """None when both engines agree, else what differs first."""
    result = catalog.queries()[name](spark, data_dir)
    mine = _rows(result.columns, [tuple(r) for r in result.collect()])
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return None if mine else "no rows"
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(result.columns):
        return f"columns differ: {sorted(set(names) ^ set(result.columns))}"
    theirs = _rows(names, cursor.fetchall())
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    for left, right in zip(mine, theirs):
        if left != right:
            ordered = sorted(names)
            return "; ".join(f"{n}: {a} | {b}" for n, a, b in zip(ordered, left, right) if a != b)[:600]
    return None


def main(data_dir: str, wanted: list[str]) -> int:
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    connection, failed = oracle(data_dir), 0
    for name in wanted or list(catalog.queries()):
        start = time.time()
        try:
            problem = check(spark, connection, data_dir, name)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    arguments = sys.argv[1:]
    sys.exit(main(arguments[0] if arguments else "/root/testdata/sf0.001", arguments[1:]) > 0)
