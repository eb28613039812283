"""Compare a query with its SQL text on DuckDB, value by value and order-free.

Run as a script to check every query: ``python tests/oracle.py [dir] [name ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{directory}/{t}.parquet'")
    return con


def _cell(v: object) -> object:
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
    return str(v)


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else a short description."""
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = _rows(want_cols, cur.fetchall())
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} != {sorted(want_cols)}"
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if got == want:
        return None
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; only here {[r for r in got if r not in set(want)][:2]}; only there {[r for r in want if r not in set(got)][:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, e.g. {str(bad[:2])[:900]}"


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from muniframe.session import build_session

    args = sys.argv[1:]
    directory = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("OFF")
    con, sqls, failed = connect(directory), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if args and name not in args:
            continue
        began = time.time()
        try:
            df = fn(spark, directory)
            problem = difference(df, con, sqls[name]) if name in sqls else f"no sql, {len(df.collect())} rows"
        except Exception as e:  # a report for every query is wanted
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(problem and not problem.startswith("no sql"))
        print(f"{name:32s} {time.time() - began:6.1f}s  {problem or 'ok'}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
