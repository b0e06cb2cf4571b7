"""Run registered queries next to their checking SQL and report differences."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, int):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def compare(spark, duck, name, queries, oracles, folder):
    df = queries[name](spark, folder)
    cols = sorted(df.columns)
    t = time.time()
    df.write.format("noop").mode("overwrite").save()
    print(f"[{time.time() - t:.1f}s] ", end="")
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    if name not in oracles:
        return len(got), None, True, []
    cur = duck.execute(oracles[name])
    ocols = [d[0] for d in cur.description]
    rows = cur.fetchall()
    if sorted(ocols) != cols:
        return len(got), len(rows), False, [("columns", cols, sorted(ocols))]
    want = sorted(tuple(canon(r[ocols.index(c)]) for c in cols) for r in rows)
    if got == want:
        return len(got), len(want), True, []
    from collections import Counter

    a, b = Counter(got), Counter(want)
    return len(got), len(want), False, [("spark only", *list((a - b))[:3]), ("sql only", *list((b - a))[:3])]


def duck_over(folder):
    import duckdb

    from claimcheck.plans.card_model import BASE_TABLES

    c = duckdb.connect()
    for b in BASE_TABLES:
        c.execute(f"CREATE VIEW {b} AS SELECT * FROM '{folder}/{b}.parquet'")
    return c


def main(names, folder="/root/testdata/sf0.01"):
    import __spark_entry__ as entry
    from claimcheck.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    duck = duck_over(folder)
    bad = []
    for n in names or queries:
        t = time.time()
        try:
            got, want, ok, diff = compare(spark, duck, n, queries, oracles, folder)
            print(f"{'ok ' if ok else 'BAD'} {n:28s} spark={got} sql={want} {time.time() - t:.1f}s", flush=True)
            if not ok:
                bad.append(n)
                for d in diff:
                    print("     ", str(d)[:1500])
        except Exception as e:
            bad.append(n)
            print(f"ERR {n}: {str(e)[:900]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    import os

    main(sys.argv[1:], os.environ.get("SF", "/root/testdata/sf0.01"))
