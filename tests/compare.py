"""Runs named queries and their oracle side by side and compares whole results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0 if v else 0.0)
    if isinstance(v, int):
        return str(v)
    return str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(str(_cell(r[i])) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if sql is None:
        return len(rows), took, "no oracle"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    gc, g = normal(df.columns, rows)
    wc, w = normal(cols, want)
    if gc != wc:
        return len(rows), took, f"COLUMNS {gc} != {wc}"
    if len(g) != len(w):
        return len(rows), took, f"ROWS {len(g)} != {len(w)}"
    diff = [(a, b) for a, b in zip(g, w) if a != b]
    if diff:
        return len(rows), took, f"VALUES {len(diff)} of {len(g)}: {gc} {diff[0]}"
    return len(rows), took, "ok"


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from ledgerloom.session import local_session

    sf = argv[1]
    names = argv[2:]
    spark = local_session(8)
    con = connect(sf)
    oracle = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if names and not any(n in name for n in names):
            continue
        try:
            n, took, verdict = compare(spark, con, name, fn, oracle.get(name), sf)
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            n, took, verdict = -1, 0.0, f"ERROR {type(e).__name__}: {str(e)[:700]}"
        bad += verdict not in ("ok", "no oracle")
        print(f"{name:38s} rows={n:<8} {took:6.2f}s {verdict}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv)
