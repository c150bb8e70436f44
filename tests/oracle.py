"""Compare a registered query with its SQL: ``python tests/oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 4")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in data)


def compare(df, con, sql):
    got_cols, got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(diff)} of {len(got)} rows differ, first {diff[0]}" if diff else None


def main():
    import __spark_entry__ as entry
    from textlake.session import clear_scratch, local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark, con = local_session(8), duck(sf)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf)
            sql = entry.oracle_sql().get(name)
            note = compare(df, con, sql) if sql else f"(no SQL) {df.count()} rows"
        except Exception as e:  # report and go on
            note = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        clear_scratch(spark)
        failed = note is not None and not note.startswith("(no SQL)")
        bad += failed
        print(f"{'FAIL' if failed else 'ok  '} {name:26s} {time.time() - start:6.1f}s {note or ''}", flush=True)
    print(f"{bad} failed of {len(names)}")


if __name__ == "__main__":
    main()
