"""Batched clusterings against plain loops, exact draws, and rows with NULL keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import batched, search, windows
from tidemark.plans.staging import stage


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_draws_sum_to_n_wherever_they_are_counted(n):
    for draw in range(1, 20):
        whole = batched.draw_counts(np.arange(n), n, draw, 42)
        assert whole.sum() == n
        some = np.arange(n)[:: 3]
        assert (batched.draw_counts(some, n, draw, 42) == whole[some]).all()
    counts = np.array([batched.draw_counts(np.arange(n), n, d, 1) for d in range(400)])
    assert abs(counts.mean() - 1) < 1e-9 and (n == 1 or abs(counts.var() - (1 - 1 / n)) < 0.2)


def blobs(spark):
    rng = np.random.default_rng(0)
    rows = []
    for version, means in (("A", [(0, 0), (9, 0), (0, 9)]), ("B", [(0, 0), (7, 7)])):
        for i in range(240):
            x, y = rng.normal(means[i % len(means)], 0.5)
            rows.append((version, f"r{i % 12}" if i % 5 else None, f"l{i % len(means)}", float(x), float(y), "q"))
    return rows, spark.createDataFrame(rows, "version string, source_record_id string, label string, s_a double, s_b double, va_quadrant string")


def test_fits_of_many_groups(spark):
    rows, df = blobs(spark)
    found = {}
    for parts in (1, 5):
        got = batched.candidates(df.repartition(parts), ["a", "b"], ["version"], stage, ks=(2, 3), iterations=4, restarts=(("kmeans", 3), ("gmm", 2)))
        found[parts] = {(r.version, r.algorithm, r.k): r for r in got.collect()}
    one = found[1]
    assert set(one) == {(v, a, k) for v in "AB" for a in ("kmeans", "gmm") for k in (2, 3)}
    for key in (("A", "kmeans", 3), ("A", "gmm", 3), ("B", "kmeans", 2), ("B", "gmm", 2)):
        r = one[key]
        assert r.n_samples == 240 and r.label_ari == pytest.approx(1) and r.label_nmi == pytest.approx(1)
        assert r.bootstrap_mean_ari == pytest.approx(1) and r.effective_bootstrap_runs == 4 and r.centroid_drift_mean < 0.5
    assert all(found[5][key].label_ari == pytest.approx(one[key].label_ari) for key in (("A", "kmeans", 3), ("B", "gmm", 2)))
    assert one["A", "gmm", 3].bic < one["A", "gmm", 2].bic


def test_lloyd_step_and_likelihood():
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(50, 2)), rng.integers(0, 3, 50).astype(float)
    m = batched.first_model(x, 0, "kmeans", 3, 0, "row", 1)
    own = m.scores(x).argmax(1)
    assert np.allclose(m.scores(x), -((x[:, None] - m.means) ** 2).sum(2))
    after, _ = m.step(m.sums(batched.terms(x[:20]), w[:20]) + m.sums(batched.terms(x[20:]), w[20:]))
    for c in range(3):
        assert np.allclose(after.means[c], np.average(x[own == c], axis=0, weights=w[own == c]))
    g = batched.first_model(x, 0, "gmm", 2, 0, "row", 1)
    merits = []
    for _ in range(8):
        g, _ = g.step(g.sums(batched.terms(x), np.ones(50)))
        merits.append(g.merit)
    assert all(b >= a - 1e-6 for a, b in zip(merits, merits[1:]))


def test_small_groups_are_left_out(spark):
    _, df = blobs(spark)
    got = batched.candidates(df.limit(30), ["a", "b"], ["version"], stage, ks=(2,), iterations=1)
    assert got.count() == 0


def test_label_runs_with_missing_labels(spark):
    codes = [1, 1, 1, 1, 1, None, None, None, 1, 1, 2, 2]
    track = spark.createDataFrame([("r", i, c) for i, c in enumerate(codes)], "recording_id string, i long, label_code int")
    runs = sorted((r.run_start, r.run_end, r.label_code) for r in windows.label_runs(track, chunk_rows=3).collect())
    assert runs == [(0, 5, 1), (5, 8, None), (8, 10, 1), (10, 12, 2)]


def test_folds_keep_rows_without_a_subject(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "subject_id string, x int")
    from tidemark.operators.ordered import null_safe_join

    kept = null_safe_join(rows, search.subject_folds(rows, 2), ["subject_id"])
    assert kept.count() == 3 and kept.where(F.col("fold").isNull()).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_draws_are_counted_once_before_the_passes(spark, parts):
    places = spark.createDataFrame([(g, i, n, f"r{i}") for g, n in ((0, 40), (1, 7)) for i in range(n)], "group int, record_place long, record_n long, record string")
    got = batched.drawn(places.repartition(parts), "record", 5, 42).collect()
    want = {(g, d): batched.draw_counts(np.arange(n), n, d, 42) for g, n in ((0, 40), (1, 7)) for d in range(1, 6)}
    assert len(got) == 47 and all(r.record_drawn == [want[r.group, d][r.record_place] for d in range(1, 6)] for r in got)
