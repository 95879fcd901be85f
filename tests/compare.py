"""Runs queries and their SQL side by side: python tests/compare.py [sf] [name part]."""

import math
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def norm(v):
        if isinstance(v, bool):
            return v
        if isinstance(v, int):
            return float(v)
        if isinstance(v, float):
            return None if math.isnan(v) else v
        return v

    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def connect(path):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        file = f"{path}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{file}{'/*.parquet' if os.path.isdir(file) else ''}')")
    return con


def compare(spark, con, path, name, query, sql):
    df = query(spark, path)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} and {len(want[1])} rows"
    bad = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    return f"{len(bad)} of {len(got[1])} rows differ, first {bad[0]}" if bad else None


if __name__ == "__main__":
    import time

    from shotloom import catalog
    from shotloom.session import session

    sf, part = (sys.argv + ["0.01", ""])[1:3] if len(sys.argv) > 1 else ("0.01", "")
    part = sys.argv[2] if len(sys.argv) > 2 else ""
    path = f"/root/testdata/sf{sf}"
    spark = session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(path)
    oracles, failed = catalog.oracle_sql(), 0
    for name, query in catalog.queries().items():
        if part not in name:
            continue
        began = time.time()
        try:
            if name in oracles:
                said = compare(spark, con, path, name, query, oracles[name])
            else:
                said = None if query(spark, path).count() >= 0 else "?"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        failed += said is not None
        print("ok  " if said is None else "BAD ", name, f"{time.time() - began:.1f}s", "" if name in oracles else "(no SQL)", said or "", flush=True)
    print(f"{failed} failed")
    sys.exit(bool(failed))
