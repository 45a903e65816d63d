"""Compare registered queries with their SQL: ``python -m tests.oracle [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


SPENT = [0.0]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if value == 0 or math.isnan(value):
            return "0.0" if value == 0 else "nan"
        return repr(value)
    return str(value)


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    """None when both results hold the same columns and rows, else a short description."""
    got_cols = df.columns
    collected = df.collect()
    SPENT[0] = time.time()
    got = _rows(got_cols, collected)
    res = con.execute(sql)
    want_cols = [d[0] for d in res.description]
    want = _rows(want_cols, res.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)}/{len(got)} rows differ; {sorted(got_cols)}\n   got  {bad[0][0]}\n   want {bad[0][1]}"
    if not got:
        return "EMPTY on both sides"
    return None


def main() -> int:
    from tests.session import local_session
    from tidewatch.workload import load

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    queries, oracles = load()
    spark = local_session()
    con = connect(sf_dir)
    failed = 0
    names = [n for n in queries if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    for name in names:
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                why = difference(df, con, oracles[name])
            else:
                n = len(df.collect())
                SPENT[0] = time.time()
                why = None if n else "no rows"
        except Exception as e:  # report and go on
            why = "".join(traceback.format_exception_only(type(e), e))[:1500]
            if "-v" in sys.argv:
                traceback.print_exc()
        kind = "sql" if name in oracles else "rows"
        if why:
            failed += 1
            print(f"FAIL {name} ({time.time() - t:.1f}s): {why}", flush=True)
        else:
            print(f"ok   {name} [{kind}] {SPENT[0] - t:.1f}s", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
