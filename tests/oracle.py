"""Run registered queries and their SQL side by side.

    python -m tests.oracle [sf_dir] [setting=value ...] [name ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time
import traceback

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def kind(dtype: str) -> str:
    dtype = dtype.lower()
    if any(k in dtype for k in ("int", "long", "short", "byte")):
        return "int"
    if any(k in dtype for k in ("double", "float")):
        return "float"
    if any(k in dtype for k in ("char", "string")):
        return "text"
    return "bool" if "bool" in dtype else dtype


def canonical(rows: list[tuple], cols: list[str]) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    cell = lambda v: repr(0.0 if isinstance(v, float) and v == 0 else v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    start = time.time()
    got_rows = [tuple(r) for r in df.collect()]
    compare.collect_seconds = time.time() - start
    got_kinds = {f.name: kind(f.dataType.simpleString()) for f in df.schema}
    rel = con.sql(sql)
    want_kinds = dict(zip(rel.columns, (kind(str(t)) for t in rel.types)))
    if got_kinds != want_kinds:
        return f"schema: spark {got_kinds} sql {want_kinds}"
    got, want = canonical(got_rows, df.columns), canonical(rel.fetchall(), rel.columns)
    if len(got) != len(want):
        return f"rows: spark {len(got)} sql {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"first difference (columns {sorted(df.columns)}):\n  spark {str(g)[:600]}\n  sql   {str(w)[:600]}"
    return None if got else "no rows"


def main() -> int:
    from sieve.operators.spool import release
    from sieve.queries import ORACLES, QUERIES
    from sieve.session import get_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    conf = dict(a.split("=", 1) for a in args if "=" in a)
    args = [a for a in args if "=" not in a]
    spark, con, bad = get_session(8, **conf), duck(sf_dir), 0
    for name in args or QUERIES:
        start = time.time()
        compare.collect_seconds = 0.0
        try:
            df = QUERIES[name](spark, sf_dir)
            build = time.time() - start
            if name in ORACLES:
                found = compare(df, con, ORACLES[name])
                state = "ok" if found is None else f"DIFFERENT {found}"
            else:
                state = f"ok, {df.count()} rows only"
        except Exception as e:  # noqa: BLE001
            state = f"FAILED {e.__class__.__name__}: {str(e)[:1500]}"
            if args:
                traceback.print_exc()
        bad += not state.startswith("ok")
        print(f"{name:28s} spark {build + compare.collect_seconds:6.1f}s {state}", flush=True)
    release(spark)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main())
