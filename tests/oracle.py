"""Compare registered queries with their SQL in DuckDB.

``python -m tests.oracle [sf_dir] [name ...]`` prints one line per query.
"""

import datetime
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def _plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, int) and not isinstance(value, bool):
        return str(value)
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(frame, connection, sql):
    """An empty string when both sides agree, else what differs."""
    spark_names, spark_rows = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    sql_names, sql_rows = _rows(names, result.fetchall())
    if spark_names != sql_names:
        return f"columns {spark_names} != {sql_names}"
    if len(spark_rows) != len(sql_rows):
        return f"{len(spark_rows)} rows != {len(sql_rows)}"
    wrong = [(a, b) for a, b in zip(spark_rows, sql_rows) if a != b]
    return f"{len(wrong)} of {len(sql_rows)} rows differ, first {wrong[0]}" if wrong else ""


def main(arguments):
    from pricemill.registry import ORACLES, QUERIES
    from pricemill.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    if arguments and "/" in arguments[0]:
        sf_dir = arguments.pop(0)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failed = []
    for name in arguments or QUERIES:
        begun = time.time()
        try:
            frame = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                problem = compare(frame, connection, ORACLES[name])
                rows = "sql"
            else:
                problem, rows = "", f"{frame.count()} rows"
        except Exception as error:  # noqa: BLE001
            problem, rows = f"{type(error).__name__}: {str(error)[:600]}", ""
        if problem:
            failed.append(name)
        print(f"{name:28s} {'FAIL ' + problem if problem else 'ok ' + rows}"
              f" {time.time() - begun:.1f}s", flush=True)
    print(f"{len(failed)} failed: {' '.join(failed)}")


if __name__ == "__main__":
    main(sys.argv[1:])
