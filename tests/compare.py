"""Runs registered queries next to their SQL in DuckDB and compares all rows.

``python -m tests.compare [--sf 0.01] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return True, f"rows={len(got)} spark={t1 - t0:.1f}s (no sql)"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    took = f"rows={len(got)} spark={t1 - t0:.1f}s duck={time.time() - t1:.1f}s"
    if sorted(cols) != sorted(df.columns):
        return False, f"columns differ: {sorted(df.columns)} vs {sorted(cols)}"
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    duck = {d[0]: str(d[1]) for d in cur.description}
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
            "boolean": "BOOLEAN"}
    odd = [f"{c}: {kinds[c]} vs {duck[c]}" for c in kinds if same.get(kinds[c]) != duck[c]]
    if len(got) != len(want):
        return False, f"row counts differ: {len(got)} vs {len(want)} {took}"
    for g, w in zip(got, want, strict=True):
        if g != w:
            return False, f"first difference ({sorted(cols)}):\n   spark {g}\n   duck  {w}\n   {odd}"
    return not odd, took + (f" TYPES {odd}" if odd else "")


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from talkmill.session import local_session

    args = sys.argv[1:]
    sf = "0.01"
    if "--sf" in args:
        at = args.index("--sf")
        sf = args[at + 1]
        del args[at:at + 2]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = connection(sf_dir)
    sqls = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            ok, note = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as exc:  # report and go on
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
