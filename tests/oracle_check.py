"""Run named queries on Spark and their SQL on DuckDB and compare the results.

python tests/oracle_check.py [sf] [name-part ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "" if math.isnan(v) else (repr(v + 0.0) if v else "0.0")
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    return str(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql):
    """None when equal, else a short description."""
    a_cols, a = canon(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.execute(sql)
    b_cols, b = canon([d[0] for d in rel.description], rel.fetchall())
    if a_cols != b_cols:
        return f"columns {a_cols} vs {b_cols}"
    if len(a) != len(b):
        extra = list(set(a) - set(b))[:2], list(set(b) - set(a))[:2]
        return f"rows {len(a)} vs {len(b)} e.g. {extra}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)}/{len(a)} rows differ {a_cols} e.g. {bad[:2]}" if bad else None


def main(argv):
    import __spark_entry__ as entry
    from crewgrid.session import build_session

    sf = argv[0] if argv else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session()
    con = connect(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in qs:
        if argv[1:] and not any(p in name for p in argv[1:]):
            continue
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            if name in sqls:
                res = compare(df, con, sqls[name])
                n = ""
            else:
                n, res = len(df.collect()), None
            tag = "ok" if name in sqls else f"rows={n}"
            if res:
                bad += 1
                tag = "DIFF " + res[:700]
        except Exception as e:
            bad += 1
            tag = "ERR " + str(e)[:700]
        print(f"{name:45s} {time.time() - t0:6.1f}s {tag}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
