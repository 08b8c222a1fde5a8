"""Runs a query and its SQL and compares the rows, order aside."""

from __future__ import annotations

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if glob.glob(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    if hasattr(v, "tzinfo") and v is not None:
        return str(v.replace(tzinfo=None))
    if type(v).__name__ == "Decimal":
        return repr(round(float(v), 9) + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def differences(spark, con, query, sql: str, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con.execute(sql)
    want = rows_of([c[0] for c in con.description], con.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} against {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows against {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(bad)} of {len(got[1])} rows differ, first {str(bad[0])[:300]}" if bad else ""


def main(sf_dir: str, names: list[str]) -> None:
    import sys
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from sievework import registry
    from sievework.session import local_session, prepare

    spark = prepare(local_session(memory="6g"))
    spark.sparkContext.setLogLevel("OFF")
    con, sql = connect(sf_dir), registry.oracle_sql()
    for k, q in registry.queries().items():
        if names and k not in names:
            continue
        t = time.time()
        try:
            said = differences(spark, con, q, sql[k], sf_dir) if k in sql else f"rows only: {len(q(spark, sf_dir).collect())}"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:500]}"
        if said or time.time() - t > 3:
            print(f"{k} {time.time() - t:.1f}s {said}", flush=True)


if __name__ == "__main__":
    import sys

    main(sys.argv[1], sys.argv[2:])
