"""Runs registered queries next to their SQL in DuckDB: ``python tests/check.py [sf] [name-part ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from faresight.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

STRICT = bool(os.environ.get("CHECK_STRICT"))
KINDS = {
    "TINYINT": "int", "INTEGER": "int", "BIGINT": "int", "DOUBLE": "float", "VARCHAR": "text", "BOOLEAN": "bool", "DATE": "date",
    "tinyint": "int", "int": "int", "bigint": "int", "double": "float", "string": "text", "boolean": "bool", "date": "date",
}


def kinds(pairs):
    return {name: KINDS.get(str(kind), str(kind)) for name, kind in pairs}


def normal(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        if STRICT:
            return repr(f + 0.0)
        return repr(round(f, 9) + 0.0) if not f.is_integer() else str(int(f))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple(str(x) for x in r))


def compare(con, df, sql):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "rows", len(got[1]), ""
    rel = con.sql(sql)
    want = rows_of(list(rel.columns), rel.fetchall())
    left, right = kinds(df.dtypes), kinds(zip(rel.columns, rel.dtypes))
    if left != right:
        return "TYPES", len(got[1]), str({c: (left.get(c), right.get(c)) for c in {*left, *right} if left.get(c) != right.get(c)})
    if got[0] != want[0]:
        return "COLUMNS", len(got[1]), f"{got[0]} / {want[0]}"
    if got[1] == want[1]:
        return "ok", len(got[1]), ""
    a, b = set(got[1]), set(want[1])
    diff = f"spark {len(got[1])} sql {len(want[1])} only-spark {sorted(a - b, key=str)[:2]} only-sql {sorted(b - a, key=str)[:2]}"
    return "DIFF", len(got[1]), diff


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def main() -> int:
    import __spark_entry__ as entry

    size = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    sf = size if size.startswith("/") else f"/root/testdata/sf{size}"
    settings = dict(s.split("=", 1) for s in os.environ.get("CHECK_CONF", "").split() if s)
    spark = local_session("check", 8, **settings)
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            verdict, n, note = compare(con, fn(spark, sf), oracles.get(name))
        except Exception as err:
            verdict, n, note = "ERROR", 0, str(err)[:600]
        bad += verdict not in ("ok", "rows")
        print(f"{verdict:8}{name:32}{n:8} rows {time.time() - start:6.2f}s  {note}", flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
