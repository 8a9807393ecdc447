"""Runs queries and their check SQL side by side: rows, names, types, values.

    python -m tests.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE", "smallint": "SMALLINT",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, Decimal):
        return value.normalize()
    return value


def sort_key(row: tuple) -> tuple:
    return tuple((v is None, str(v)) for v in row)


def differences(con, frame, sql: str) -> str | None:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    kinds = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    order = sorted(names)
    if sorted(frame.columns) != order:
        return f"columns {sorted(frame.columns)} != {order}"
    for field in frame.schema.fields:
        mine = field.dataType.simpleString()
        mine = TYPES.get(mine, mine.upper())
        if mine != kinds[field.name]:
            return f"type of {field.name}: {mine} != {kinds[field.name]}"
    got = [tuple(normal(v) for v in r) for r in frame.select(*[f"`{c}`" for c in order]).collect()]
    want = [tuple(normal(r[names.index(c)]) for c in order) for r in expected]
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got.sort(key=sort_key)
    want.sort(key=sort_key)
    for g, w in zip(got, want):
        if g != w:
            return f"first difference\n   got  {g}\n   want {w}\n   ({order})"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from tideline.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.001"
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    checks = entry.oracle_sql()
    for name, run in entry.queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            frame = run(spark, sf_dir)
            problem = differences(con, frame, checks[name]) if name in checks else f"no check, {frame.count()} rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        count = con.execute(f"SELECT count(*) FROM ({checks[name]})").fetchone()[0] if name in checks and problem is None else ""
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:26s} {time.time() - start:6.2f}s {count} {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(min(main(), 1))
