"""Compare registered queries with their DuckDB SQL: ``python tests/oracle_check.py [sf] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as entry
from cliptide.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (a != a and b != b)
    return type(a) is type(b) and a == b


def order_key(row):
    return tuple((v is None, str(type(v)), v) if not isinstance(v, list) else (False, "list", str(v)) for v in row)


def compare(spark, con, sf_dir: str, name: str) -> str:
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=order_key)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows only: {len(got)}"
    want_rel = con.sql(sql)
    if sorted(want_rel.columns) != cols:
        return f"COLUMNS {cols} != {sorted(want_rel.columns)}"
    want = sorted(con.sql(f"select {', '.join(cols)} from ({sql}) q").fetchall(), key=order_key)
    if len(got) != len(want):
        return f"ROWS {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if not all(map(same, g, w))]
    if bad:
        return f"VALUES {len(bad)} of {len(got)} differ in {cols}, first {bad[0]}"
    kinds = dict(zip(want_rel.columns, map(str, want_rel.types)))
    wide = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    off = [f"{c}:{t}/{kinds[c]}" for c, t in df.dtypes if wide.get(t, t) != kinds[c]]
    return f"ok {len(got)}" + (f" TYPES {off}" if off else "")


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = duck(sf_dir)
    names = [n for n in entry.queries() if not sys.argv[2:] or any(n.startswith(p) for p in sys.argv[2:])]
    failed = 0
    for n in names:
        t = time.time()
        try:
            said = compare(spark, con, sf_dir, n)
        except Exception as e:
            said = f"ERROR {type(e).__name__} {str(e)[:1500]}"
        failed += not said.startswith(("ok", "rows"))
        print(f"{n:32s} {time.time() - t:6.2f}s {said}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    spark.stop()
