"""Run registered queries beside their SQL twins: ``python tests/compare.py [--sf 0.01] [name...]``."""
from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(d: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else repr(v + 0.0)  # results carry their own rounding
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def rows_of(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(norm(r[i]) for i in at) for r in rows)


def run(name, spark, con, d, queries, oracles):
    t0 = time.time()
    df = queries[name](spark, d)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if name not in oracles:
        return f"ROWS  {name:34s} rows={len(got)} {t1 - t0:.1f}s", len(got) > 0
    cur = con.execute(oracles[name])
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    same_cols = sorted(df.columns) == sorted(names)
    a, b = rows_of(df.columns, got), rows_of(names, want)
    ok = same_cols and a == b
    msg = f"{'OK   ' if ok else 'DIFF '} {name:34s} rows={len(got)}/{len(want)} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s"
    if not ok:
        msg += f"\n   cols {sorted(df.columns)}\n    vs  {sorted(names)}"
        msg += f"\n   only spark {list((a - b).items())[:3]}\n   only duck  {list((b - a).items())[:3]}"
        msg += f"\n   differing {sum((a - b).values())}"
    return msg, ok and len(got) > 0


if __name__ == "__main__":
    from augury.session import local_session
    import __spark_entry__ as e
    args = sys.argv[1:]
    sf = "0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    d = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(d)
    q, o = e.queries(), e.oracle_sql()
    bad = 0
    for name in (args or q):
        if name not in q:
            names = [n for n in q if n.startswith(name)]
        else:
            names = [name]
        for n in names:
            try:
                msg, ok = run(n, spark, con, d, q, o)
            except Exception as ex:  # report and go on
                msg, ok = f"FAIL  {n}: {type(ex).__name__}: {str(ex)[:600]}", False
            bad += not ok
            print(msg, flush=True)
    print("bad:", bad)
