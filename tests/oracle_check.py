"""Runs registered queries next to their DuckDB oracle and reports differences.

Usage: python tests/oracle_check.py [sf] [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted([tuple(normal(row[c]) for c in cols) for row in df.collect()])
    if sql is None:
        return f"rows-only {len(got)}"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"COLUMNS differ: {set(names) ^ set(cols)}"
    order = [names.index(c) for c in cols]
    want = sorted([tuple(normal(row[i]) for i in order) for row in rel.fetchall()])
    if len(got) != len(want):
        return f"ROWS {len(got)} vs {len(want)}; {got[:1]} {want[:1]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        diff = [(c, x, y) for c, x, y in zip(cols, g, w) if x != y]
        return f"VALUES {len(bad)}/{len(got)} differ, first: {diff[:6]} row={g[:4]}"
    return f"ok {len(got)}"


def main():
    from tidemark.session import local_session

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    prefixes = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("oracle-check")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    failures = 0
    for name, query in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            outcome = compare(spark, con, query, oracles.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            outcome = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        failures += not outcome.startswith(("ok", "rows-only"))
        print(f"@@ {name}: {outcome} [{time.time() - start:.1f}s]", flush=True)
    print(f"@@ failures: {failures}")
    return failures


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
