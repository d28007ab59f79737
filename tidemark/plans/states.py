"""Registered queries: state separation and window aggregators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import aggregators as ag
from tidemark.operators import separation as sp
from tidemark.plans.mapping import SPACE, results
from tidemark.plans.output import finish
from tidemark.plans.staging import stage
from tidemark.sources.tables import fixture

K = ["version"]


def rows(spark, sf_dir):
    return results(spark, sf_dir, "hybrid", ("V4", "V5"), columns=SPACE).where(F.col("score").isNotNull())


def labels(spark, sf_dir):
    """K01."""
    return finish(sp.usable_labels(rows(spark, sf_dir), K))


def measures(spark, sf_dir):
    """K02."""
    return finish(sp.usable_measures(sp.measure_rows(rows(spark, sf_dir), K), K))


def kruskal(spark, sf_dir):
    """H and epsilon squared per measure."""
    return finish(sp.epsilon_squared(sp.kruskal(sp.measure_rows(rows(spark, sf_dir), K), [*K, "measure"])))


def _tests(spark, sf_dir):
    r = rows(spark, sf_dir)
    return sp.pair_statistics(sp.measure_rows(r, K), sp.usable_labels(r, K), K, staging=stage)


def rank_sum(spark, sf_dir):
    """U statistic and p-value of every pair and measure."""
    df = sp.with_rank_sum_p(_tests(spark, sf_dir))
    return finish(df.select(*K, "measure", "pair_key", "n_a", "n_b", "tie_term", "u", "p_value"))


def pair_statistics(spark, sf_dir):
    """K05-K07."""
    shown = ("n_a", "n_b", "mean_a", "mean_b", "mean_diff", "effect_size", "distribution_overlap")
    return finish(_tests(spark, sf_dir).select(*K, "measure", "pair_key", *shown))


def holm(spark, sf_dir):
    """K08, K09 on the p-values of the rank-sum tests."""
    df = sp.holm(sp.with_rank_sum_p(_tests(spark, sf_dir)), [*K, "measure"], "p_value", "pair_key")
    graded = sp.grade(F.col("effect_size"), F.col("distribution_overlap"), F.col("p_value_holm"))
    return finish(df.select(*K, "measure", "pair_key", "p_value_holm", graded.alias("grade")))


def centroids(spark, sf_dir):
    """K10."""
    r = rows(spark, sf_dir)
    return finish(sp.centroid_distances(r, sp.label_pairs(sp.usable_labels(r, K), K), K))


def pair_aggregate(spark, sf_dir):
    """Full pair table with p-values, aggregated per pair."""
    return finish(sp.pair_aggregate(sp.pair_table(rows(spark, sf_dir), K, staging=stage), K))


def supported_set(spark, sf_dir):
    """K12 on the supported pairs of K11."""
    return finish(sp.largest_supported_set(sp.pair_aggregate(sp.pair_table(rows(spark, sf_dir), K, staging=stage), K), K))


def _values(spark, sf_dir):
    return stage(ag.method_values(fixture(spark, sf_dir, "fx_windows")), "methods")


def window_statistics(spark, sf_dir):
    """Y01."""
    df = ag.window_statistics(fixture(spark, sf_dir, "fx_windows"))
    return finish(df.select("sample_index", "w_mean", "w_std", "w_energy", "target_rms"))


def method_values(spark, sf_dir):
    """Eight aggregation methods per window."""
    return finish(ag.method_values(fixture(spark, sf_dir, "fx_windows")))


def method_metrics(spark, sf_dir):
    """Y07, Y10."""
    return finish(ag.method_metrics(ag.method_rows(_values(spark, sf_dir))))


def scaled(spark, sf_dir):
    """Y08."""
    df = ag.scaled_for_plot(ag.method_rows(_values(spark, sf_dir)))
    return finish(df.select("method", "sample_index", "plot_value"))


def bins(spark, sf_dir):
    """Y09."""
    return finish(ag.target_bins(ag.scaled_for_plot(ag.method_rows(_values(spark, sf_dir)))))


QUERIES = {
    "k01_labels": labels,
    "k02_measures": measures,
    "k03_l07_kruskal": kruskal,
    "k04_rank_sum": rank_sum,
    "k05_k07_pair_statistics": pair_statistics,
    "k08_k09_holm_grade": holm,
    "k10_centroid_distance": centroids,
    "k11_pair_aggregate": pair_aggregate,
    "k12_supported_set": supported_set,
    "y01_window_statistics": window_statistics,
    "y02_y06_methods": method_values,
    "y07_y10_method_metrics": method_metrics,
    "y08_scaled": scaled,
    "y09_target_bins": bins,
}
