"""Pair statistics from value counts against plain sorting of every pair."""

import numpy as np
import pytest

from tidemark.operators import pairs as pr
from tidemark.operators import separation as sp

SCHEMA = "g string, label string, measure string, x double"


def plain(a, b, bins):
    a, b = np.asarray(a, float), np.asarray(b, float)
    u = sum(float((b < x).sum()) + 0.5 * float((b == x).sum()) for x in a)
    _, ties = np.unique(np.concatenate([a, b]), return_counts=True)
    lo, hi = min(a.min(), b.min()), max(a.max(), b.max())
    overlap = None
    if lo < hi:
        ha, hb = (np.histogram(v, bins, (lo, hi))[0] / len(v) for v in (a, b))
        overlap = float(np.minimum(ha, hb).sum())
    spread = ((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(a) + len(b) - 2)
    d = float((b.mean() - a.mean()) / np.sqrt(spread)) if spread > 0 else None
    return {"u": u, "tie_term": float((ties**3 - ties).sum()), "overlap": overlap, "d": d}


def check(spark, values, bins):
    rows = [(g, name, "score", float(x)) for (g, name), xs in values.items() for x in xs]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = sp.usable_labels(df, ["g"], 2)
    got = pr.pair_statistics(df, labels, ["g"], bins).collect()
    want = sum(n * (n - 1) // 2 for n in (sum(1 for g, _ in values if g == k) for k in {g for g, _ in values}))
    assert len(got) == want
    for row in got:
        p = plain(values[row.g, row.label_a], values[row.g, row.label_b], bins)
        assert (row.u, row.tie_term) == (p["u"], p["tie_term"])
        for mine, theirs in ((row.distribution_overlap, p["overlap"]), (row.effect_size, p["d"])):
            assert (mine is None) == (theirs is None)
            assert mine is None or mine == pytest.approx(theirs, abs=1e-9)


def test_ties_null_keys_and_constant_labels(spark):
    rng = np.random.default_rng(3)
    values = {("one", "stress"): rng.integers(0, 12, 90) / 4, ("one", "baseline"): rng.integers(4, 20, 70) / 4, ("one", "z"): rng.normal(0, 50, 40),
              (None, "a"): [2.0] * 5, (None, "b"): [2.0] * 9, (None, "c"): [1.0, 2.0, 3.0]}
    check(spark, values, 60)


def test_more_labels_than_one_pass_holds(spark):
    rng = np.random.default_rng(4)
    check(spark, {("g", f"s{i:02d}"): np.round(rng.normal(i / 9, 1, 20), 1) for i in range(pr.BLOCK + 3)}, 10)


def test_missing_values_and_empty_tables(spark):
    rows = [("g", "a", "score", x) for x in (1.0, 2.0, None, float("nan"))] + [("g", "b", "score", x) for x in (3.0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert pr.pair_statistics(df, sp.usable_labels(df, ["g"], 2), ["g"]).count() == 0  # one value of b
    none = df.where("false")
    assert pr.pair_statistics(none, sp.usable_labels(none, ["g"], 2), ["g"]).count() == 0
