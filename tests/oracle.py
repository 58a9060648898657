"""Run registered queries next to their checking SQL and compare all rows.

``python tests/oracle.py [names...]`` with the scale folder in ``SF_DIR``.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def database(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cells(frame) -> list[tuple]:
    columns = sorted(frame.columns)

    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "null"
        return repr(v.item() if hasattr(v, "item") else v)

    return sorted(tuple(plain(v) for v in row) for row in frame[columns].astype(object).values)


def differences(spark_frame, sql_frame) -> list[str]:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return [f"columns {sorted(spark_frame.columns)} != {sorted(sql_frame.columns)}"]
    ours, theirs = cells(spark_frame), cells(sql_frame)
    if ours == theirs:
        return []
    names = sorted(spark_frame.columns)
    only_ours = sorted(set(ours) - set(theirs))[:2]
    only_theirs = sorted(set(theirs) - set(ours))[:2]
    out = [f"rows {len(ours)} vs {len(theirs)}"]
    for a, b in zip(only_ours, only_theirs):
        out.append(str([(n, x, y) for n, x, y in zip(names, a, b) if x != y]) + f" at {a[:4]}")
    if not only_ours or not only_theirs:
        out.append(f"ours {only_ours} theirs {only_theirs}")
    return out


def main() -> int:
    from paneltide.plans.catalog import ORACLES, QUERIES
    from paneltide.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:] or list(QUERIES)
    spark, con = local_session(8), database(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            ours = QUERIES[name](spark, sf_dir).toPandas()
            took = time.time() - start
            if name in ORACLES:
                start = time.time()
                found = differences(ours, con.execute(ORACLES[name]).df())
                state = "ok" if not found else "DIFF"
                sql_took = time.time() - start
            else:
                found, state, sql_took = [], "rows only", 0.0
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
            continue
        bad += state == "DIFF"
        print(f"{state} {name} rows={len(ours)} spark={took:.1f}s sql={sql_took:.1f}s", flush=True)
        for line in found:
            print("    ", line[:700], flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
