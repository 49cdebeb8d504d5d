"""Side-by-side run of registered queries and their SQL.

    python -m tests.compare [--sf 0.01] [name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb

from shelfmark.plans import registry

DATA = "/root/testdata/sf{}"


def connection(folder: str):
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for table in registry.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def _kind(spark_type: str) -> str:
    return {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
            "date": "DATE", "timestamp": "TIMESTAMP"}.get(spark_type, spark_type.upper())


def _key(row):
    return tuple((v is not None, str(type(v)), v) for v in row)


def compare(spark, con, folder: str, name: str) -> str:
    """'' when the results agree, else what differs."""
    df = registry.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    mine = sorted((tuple(r) for r in df.select(*columns).collect()), key=_key)
    sql = registry.ORACLES.get(name)
    if sql is None:
        return "" if mine else "no rows"
    cur = con.execute(sql)
    described = [(d[0], str(d[1])) for d in cur.description]
    rows = cur.fetchall()
    order = sorted(range(len(described)), key=lambda i: described[i][0])
    if [described[i][0] for i in order] != columns:
        return f"columns {columns} != {[described[i][0] for i in order]}"
    types = {f: _kind(t) for f, t in df.dtypes}
    wrong = [(n, types[n], t) for n, t in described if types[n] != t]
    theirs = sorted((tuple(r[i] for i in order) for r in rows), key=_key)
    if wrong:
        return f"types {wrong}"
    if len(mine) != len(theirs):
        a, b = set(mine), set(theirs)
        extra, lack = sorted(a - b, key=_key)[:3], sorted(b - a, key=_key)[:3]
        return f"rows {len(mine)} != {len(theirs)}; only here {extra}; only there {lack}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"values {a} != {b}"
    if not mine:
        return "EMPTY on both sides"
    return ""


def main(argv: list[str]) -> int:
    from tests.conftest import make_session

    import shelfmark.plans  # noqa: F401

    sf = "0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf = argv[at + 1]
        argv = argv[:at] + argv[at + 2:]
    names = argv or list(registry.QUERIES)
    spark, folder = make_session(), DATA.format(sf)
    con = connection(folder)
    bad = 0
    for name in names:
        began = time.time()
        try:
            verdict = compare(spark, con, folder, name)
        except Exception as exc:  # report and go on with the next query
            verdict = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += bool(verdict)
        rows_only = "" if name in registry.ORACLES else " (rows only)"
        print(f"{'ok  ' if not verdict else 'BAD '} {name}{rows_only} {time.time() - began:.1f}s {verdict}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
