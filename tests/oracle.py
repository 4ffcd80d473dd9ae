"""Run catalog queries and their SQL side by side.

    python tests/oracle.py [--dir DIR] [names or prefixes ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value + 0.0:.10g}"
    if isinstance(value, int):
        return str(value)
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def difference(spark, con, name: str, path: str) -> str | None:
    """None when equal, else a short description."""
    from tailgauge.plans import QUERIES, SQL

    df = QUERIES[name](spark, path)
    found_columns, found = table(df.columns, df.collect())
    if name not in SQL:
        return None if found else "no rows"
    result = con.execute(SQL[name])
    columns = [d[0] for d in result.description]
    want_columns, want = table(columns, result.fetchall())
    if found_columns != want_columns:
        return f"columns {found_columns} != {want_columns}"
    if not want:
        return "no rows on either side" if not found else f"{len(found)} rows != 0"
    if len(found) != len(want):
        return f"{len(found)} rows != {len(want)}"
    bad = [(a, b) for a, b in zip(found, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(want)} rows differ, columns {found_columns}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"
    return None


def main() -> int:
    from tailgauge.plans import QUERIES, SQL
    from tailgauge.session import build_session

    arguments = sys.argv[1:]
    path = "/root/testdata/sf0.01"
    if "--dir" in arguments:
        at = arguments.index("--dir")
        path = arguments[at + 1]
        del arguments[at : at + 2]
    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(path)
    failed = 0
    for name in QUERIES:
        if arguments and not any(name.startswith(a) for a in arguments):
            continue
        start = time.time()
        try:
            problem = difference(spark, con, name, path)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        kind = "" if name in SQL else " (rows only)"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name}{kind} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
