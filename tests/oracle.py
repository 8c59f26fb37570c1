"""Compare registered queries with their SQL run by DuckDB.

``python tests/oracle.py [name ...]`` checks the named queries (or prefixes).
"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, bool):
        return value
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(data, key=repr)


def compare(spark, con, fn, sql, sf):
    """None when equal, otherwise a short description of the difference."""
    df = fn(spark, sf)
    left = _table(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    right = _table([d[0] for d in result.description], result.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        a, b = set(map(repr, left[1])), set(map(repr, right[1]))
        return f"rows {len(left[1])} != {len(right[1])}; spark only {sorted(a - b)[:2]}; sql only {sorted(b - a)[:2]}"
    if left[1] != right[1]:
        a, b = Counter(map(repr, left[1])), Counter(map(repr, right[1]))
        return (f"{sum((a - b).values())} of {len(left[1])} rows differ; columns {left[0]}; "
                f"spark only {sorted((a - b))[:3]}; sql only {sorted((b - a))[:3]}")
    if not left[1]:
        return "no rows on either side"
    return None


def main(names):
    import __spark_entry__ as entry
    from shelfscan.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    fns, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in fns.items():
        if names and not any(name == n or name.startswith(n) for n in names):
            continue
        begin = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, fn, sqls[name], sf)
            else:
                n = fn(spark, sf).count()
                problem = None if n else "no rows"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        kind = "sql" if name in sqls else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {time.time() - begin:6.2f}s {name} {problem or ''}", flush=True)
    print("failed:", failed)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
