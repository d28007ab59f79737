"""Exact top-k against brute force."""

import math
import random

from conftest import SF
from oracle_check import compare, connect
from pyspark.sql import functions as F

from tidemark.llm import topk


def plain(rows, is_query, k):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, w in usable:
        if is_query(q):
            scored = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in usable if i != q)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def found(df, condition, **options):
    return sorted(tuple(r) for r in topk.exact_topk(df, condition, **options).collect())


def test_whole_table_against_sql(spark):
    from __spark_entry__ import oracle_sql, queries

    assert compare(spark, connect(SF), queries()["op5_exact_topk"], oracle_sql()["op5_exact_topk"], SF).startswith("ok")


def test_ties_sparse_rows_and_small_blocks(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.0, 0.5, -0.25]) for _ in range(rng.choice([3, 5]))]) for i in range(-40, 160)] + [(3, [0.5, 0.5, 0.5]), (3, [0.5, 0.5, 0.5])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, score string, part int")
    want = plain(rows, lambda q: q % 3 == 0, 5)
    assert found(df, F.col("vec_id") % 3 == 0) == want
    assert found(df, F.col("vec_id") % 3 == 0, candidate_block=17, query_block=5) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [0.1, -0.1]), (1, None), (2, []), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 1.0]), (None, [1.0, 1.0]), (6, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, F.col("vec_id") % 50 == 0) == plain(rows, lambda q: q % 50 == 0, 5)
    assert found(df.where("false"), F.col("vec_id") % 50 == 0) == [] == found(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0)
