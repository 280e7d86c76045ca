"""Compare every catalogued query with its SQL: column names, row count and values.

    python tools/check_oracles.py [folder] [query ...]
"""

from __future__ import annotations

import datetime as dt
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stratalens.bindings import TABLES  # noqa: E402
from stratalens.plans.catalog import QUERIES  # noqa: E402
from stratalens.plans.oracles import ORACLES  # noqa: E402
from stratalens.session import build_session  # noqa: E402


def _value(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(row[i]) for i in order) for row in rows)


def duck_rows(folder: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    result = con.execute(sql)
    columns = [column[0] for column in result.description]
    return columns, result.fetchall()


def compare(spark, folder: str, name: str) -> str:
    """Empty when query and SQL agree, else what differs."""
    frame = QUERIES[name](spark, folder)
    got = [tuple(row) for row in frame.collect()]
    if name not in ORACLES:
        return "" if got else "no rows"
    columns, wanted = duck_rows(folder, ORACLES[name])
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(columns)}"
    ours, theirs = _rows(frame.columns, got), _rows(columns, wanted)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    differing = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(differing)} of {len(ours)} rows differ, first {differing[0]}" if differing else ""


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, folder, name)
        except Exception as error:  # a failing query must not hide the others
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        print(f"{name:28s} {time.time() - start:6.1f} s  {problem or 'ok'}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
