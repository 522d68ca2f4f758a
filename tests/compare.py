"""Compare registered queries with their SQL: python tests/compare.py SF_DIR [name-part ...]"""
from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    try:
        import duckdb
    except ImportError:
        sys.path.append("/opt/oracle")
        import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, fn, sql):
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return (len(got) > 0, f"{len(got)} rows, no SQL")
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}\n   spark {got[:2]}\n   sql   {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        diff = [(c, x, y) for c, x, y in zip(got_cols, g, w) if x != y]
        return False, f"{len(bad)} of {len(got)} rows differ, first: {diff[:4]}"
    return (len(got) > 0, f"{len(got)} rows equal")


def main():
    sf_dir, parts = sys.argv[1], sys.argv[2:]
    import __spark_entry__ as entry
    from paytide.session import local_session

    spark, con = local_session(8), duck(sf_dir)
    oracles, failed = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if parts and not any(p == name or (p.endswith("*") and name.startswith(p[:-1])) for p in parts):
            continue
        t = time.time()
        try:
            ok, note = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {note}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
