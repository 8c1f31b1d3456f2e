"""Run registered queries next to their SQL twins and compare the results.

    python tests/oracle.py [sf] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canon(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.6g}" if value != int(value) else str(int(value)) if abs(value) < 1e15 else f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canon(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, name, fn, sql):
    t0 = time.time()
    df = fn(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t0
    if sql is None:
        return took, len(got), None, ""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rows_of(names, rel.fetchall())
    if sorted(names) != sorted(df.columns):
        return took, len(got), False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if got == want:
        return took, len(got), True, ""
    a, b = set(got), set(want)
    return took, len(got), False, f"{len(got)} vs {len(want)} rows; spark only {sorted(a - b)[:3]}; sql only {sorted(b - a)[:3]}"


def main(argv):
    import __spark_entry__ as entry
    from ledgerline.session import local_session

    sf = argv[0] if argv else "0.01"
    names = argv[1:]
    folder = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            took, n, ok, note = compare(spark, con, folder, name, fn, oracles.get(name))
        except Exception as e:  # noqa: BLE001
            took, n, ok, note = 0, -1, False, "ERROR " + str(e)[:900]
        mark = {True: "ok  ", False: "FAIL", None: "rows"}[ok]
        bad += ok is False
        if ok is not True or took > 6 or n == 0 or "-v" in os.environ.get("ORACLE", ""):
            print(f"{mark} {name:28s} {took:6.2f}s {n:8d} rows {note}", flush=True)
    print("failures:", bad, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
