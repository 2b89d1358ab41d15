"""Run registered queries against their SQL twins and compare the rows.

    python -m tests.oracle [--dir /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
import traceback
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def cell(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    return value


def bag(names, rows) -> tuple[tuple[str, ...], Counter]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return tuple(names[i] for i in order), Counter(tuple(cell(row[i]) for i in order) for row in rows)


def expected(connection, sql: str):
    result = connection.execute(sql)
    return bag([column[0] for column in result.description], result.fetchall())


def actual(df):
    return bag(df.columns, [tuple(row) for row in df.collect()])


def difference(left, right, show: int = 3) -> str:
    if left[0] != right[0]:
        return f"columns differ: {left[0]} / {right[0]}"
    only_left, only_right = left[1] - right[1], right[1] - left[1]
    if not only_left and not only_right:
        return ""
    lines = [f"{sum(left[1].values())} rows in Spark, {sum(right[1].values())} expected; "
             f"{sum(only_left.values())} unexpected, {sum(only_right.values())} missing"]
    lines += [f"  spark    {row}" for row in sorted(map(repr, only_left))[:show]]
    lines += [f"  expected {row}" for row in sorted(map(repr, only_right))[:show]]
    return "\n".join(lines)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--dir", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()

    from freshet.queries import ORACLES, QUERIES
    from freshet.session import local_session

    spark = local_session("oracle", 8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(args.dir)
    failed = 0
    for name in args.names or QUERIES:
        start = time.perf_counter()
        try:
            got = actual(QUERIES[name](spark, args.dir))
            seconds = time.perf_counter() - start
            problem = difference(got, expected(connection, ORACLES[name])) if name in ORACLES else ""
            rows = sum(got[1].values())
        except Exception as error:  # report and go on with the next query
            seconds, rows = time.perf_counter() - start, -1
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {rows:7d} rows {seconds:6.2f}s"
              f"{'' if name in ORACLES else '  (no SQL)'}{chr(10) + problem if problem else ''}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
