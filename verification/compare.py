"""Runs queries on Spark and their SQL on DuckDB and compares columns, types and values.

    python -m verification.compare [--sf 0.01] [--cores 8] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import math
import time

import duckdb

TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
         "TIMESTAMP": "timestamp_ntz", "DATE": "date"}
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(row):
    return tuple((v is None, "" if v is None else repr(v)) for v in row)


def normal(rows, order):
    out = []
    for row in rows:
        vals = [row[i] for i in order]
        out.append(tuple(0.0 if isinstance(v, float) and v == 0 else v.isoformat()
                         if isinstance(v, datetime.datetime) else v for v in vals))
    return sorted(out, key=_key)


def compare(df, con, sql: str) -> str | None:
    """None when equal, otherwise what differs."""
    got = df.collect()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    want = con.execute(sql).fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    bad = {c: (t, types[c]) for c, t in df.dtypes if TYPES.get(types[c], types[c]) != t}
    if bad:
        return f"types {bad}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    a = normal(got, [df.columns.index(c) for c in sorted(names)])
    b = normal(want, [names.index(c) for c in sorted(names)])
    diff = [(x, y) for x, y in zip(a, b) if x != y and not _same_nan(x, y)]
    return f"{len(diff)} rows differ, as {sorted(names)}: {diff[:2]}" if diff else None


def _same_nan(x, y):
    return all(p == q or (isinstance(p, float) and isinstance(q, float) and math.isnan(p) and math.isnan(q))
               for p, q in zip(x, y))


def main() -> int:
    from placewise.session import local_session
    from verification import catalog

    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--cores", default="8")
    args = parser.parse_args()
    catalog.load_all()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark, con = local_session(args.cores), connect(sf_dir)
    failed = []
    for name in args.names or catalog.QUERIES:
        start = time.time()
        try:
            df = catalog.QUERIES[name](spark, sf_dir)
            if name in catalog.ORACLES:
                problem = compare(df, con, catalog.ORACLES[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'FAIL' if problem else 'ok':4} {time.time() - start:6.1f}s {name} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
