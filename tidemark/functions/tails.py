"""Tail probabilities for the few rows of a test table (vectorised over Arrow batches)."""

from __future__ import annotations

import functools
import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chi2_tail(x: float, df: int) -> float:
    """P(X > x) for integer degrees of freedom by the finite recurrence."""
    if not (x == x) or df < 1:
        return float("nan")
    if x <= 0:
        return 1.0
    half = x / 2.0
    if df % 2:
        tail, term, start = math.erfc(math.sqrt(half)), math.sqrt(half) * math.exp(-half) / math.gamma(1.5), 1.5
    else:
        tail, term, start = math.exp(-half), half * math.exp(-half), 2.0
    for i in range((df - 1) // 2):
        tail += term
        term *= half / (start + i)
    return min(tail, 1.0)


@functools.cache
def _partition_numerator(m: int) -> tuple[int, list[int]]:
    """(L, Q) with 1 / ((1-q) (1-q) (1-q^2) ... (1-q^m)) = Q(q) / (1-q^L)^(m+1), L the least common multiple of 1..m."""
    period = math.lcm(*range(1, m + 1))
    q = [1]
    for part in (1, *range(1, m + 1)):
        steps, out = period // part, [0] * (len(q) + period - part)
        for k in range(steps):
            for j, c in enumerate(q):
                out[j + k * part] += c
        q = out
    return period, q


def _partitions_up_to(k: int, m: int) -> int:
    """Partitions of all numbers up to k into parts of at most m."""
    period, q = _partition_numerator(m)
    return sum(q[j] * math.comb((k - j) // period + m, m) for j in range(k % period, min(k + 1, len(q)), period)) if k >= 0 else 0


def exact_u_tail(u: float, n1: int, n2: int) -> float:
    """Two-sided exact tail of the rank-sum statistic without ties.

    Arrangements with U <= k are the coefficients of a Gaussian binomial: with m on the small side its numerator has
    2^m terms, each a count of partitions, so nothing grows with the large side.
    """
    m, n = min(n1, n2), max(n1, n2)
    k = n1 * n2 - math.ceil(max(u, n1 * n2 - u))
    terms = [(1, 0)]
    for i in range(1, m + 1):
        terms += [(-sign, shift + n + i) for sign, shift in terms]
    count = sum(sign * _partitions_up_to(k - shift, m) for sign, shift in terms if shift <= k)
    return min(1.0, 2 * count / math.comb(n + m, m))


@F.pandas_udf(T.DoubleType())
def kruskal_p(h: pd.Series, groups: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(float(x), int(k) - 1) for x, k in zip(h, groups)])


@F.pandas_udf(T.DoubleType())
def rank_sum_p(u: pd.Series, n1: pd.Series, n2: pd.Series, tie_term: pd.Series) -> pd.Series:
    """Two-sided p: exact for small samples without ties, else normal with tie and continuity correction."""
    out = []
    for x, a, b, t in zip(u, n1, n2, tie_term):
        a, b = int(a), int(b)
        if t == 0 and min(a, b) <= 8:
            out.append(exact_u_tail(float(x), a, b))
            continue
        n = a + b
        var = a * b / 12.0 * ((n + 1) - t / (n * (n - 1)))
        if var <= 0:
            out.append(1.0)
            continue
        z = (max(x, a * b - x) - a * b / 2.0 - 0.5) / math.sqrt(var)
        out.append(min(1.0, math.erfc(z / math.sqrt(2.0))))
    return pd.Series(out, dtype="float64")
