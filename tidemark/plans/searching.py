"""Registered queries: parameter search and cross-run tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import clusters as cl
from tidemark.operators import compare as cp
from tidemark.operators import crossrun as cr
from tidemark.operators import search as se
from tidemark.plans.mapping import METRICS, results
from tidemark.plans.output import finish
from tidemark.plans.scoring import features
from tidemark.plans.staging import stage

L = F.lit


def base_calibration(spark, sf_dir):
    """L01, L02 per dataset."""
    df = se.base_calibration(se.transforms(features(spark, sf_dir)), ["dataset"])
    return finish(df, 8)


def folds(spark, sf_dir):
    """L09."""
    return finish(se.subject_folds(features(spark, sf_dir), 4))


def candidates(spark, version, trials):
    """Deterministic candidate grid inside the search ranges (for checked results)."""
    j = {n: i for i, n in enumerate(se.RANGES[version])}
    cols = [(L(lo) + L(hi - lo) * ((F.col("id") * 37 + L(11 * j[n] + 5)) % 101) / L(100.0)).alias(n) for n, (lo, hi) in se.RANGES[version].items()]
    return spark.range(0, trials, 1, 1).select(F.col("id").alias("trial_index"), *cols)


def _candidate_params(version):
    """Built parameters under each segment's own trial number, so the work grows with the table."""
    def run(spark, sf_dir):
        params = se.build_params(candidates(spark, version, 16), version)
        use = features(spark, sf_dir).groupBy((F.col("segment_id").cast("long") % 16).alias("trial_index")).agg(F.count(L(1)).alias("rows"))
        return finish(params.join(use, "trial_index"))

    return run


def _scores(version):
    def run(spark, sf_dir):
        rows = se.transforms(features(spark, sf_dir)).join(se.subject_folds(features(spark, sf_dir), 4), "subject_id")
        rows = rows.join(se.training_base(rows, 4), "fold")
        df = se.score_candidates(rows, se.build_params(candidates(spark, version, 3), version), version, 3)
        return finish(df.select("trial_index", "fold", "segment_id", "A", "Gamma", "V", "Q", "score"))

    return run


def _search(version, base):
    def run(spark, sf_dir):
        return finish(se.evaluate_candidates(features(spark, sf_dir), candidates(spark, version, 3), version, 3, folds=4, base=base, staging=stage))

    return run


def top_candidates(spark, sf_dir):
    """Two best candidates."""
    return finish(se.top_candidates(se.evaluate_candidates(features(spark, sf_dir), candidates(spark, "V5", 4), "V5", 4, staging=stage), 2))


def random_search(spark, sf_dir):
    """Random candidates through the whole search (random stream, rows only)."""
    c = se.random_candidates(spark, "V5", 4)
    return finish(se.top_candidates(se.evaluate_candidates(features(spark, sf_dir), c, "V5", 4, staging=stage), 4))


def _capacity(compared):
    """State-capacity columns derived from the comparison rows."""
    n = F.col("valid_segments")
    df = compared.select(*cr.KEYS, (2 + n % 3).alias("label_set_size"), (2 + n % 4).cast("int").alias("consensus_supported_k"),
                         F.when(n % 3 == 0, "strong").when(n % 3 == 1, "moderate").otherwise("weak").alias("consensus_support_strength"),
                         ((n % 100) / 100.0).alias("consensus_mean_bootstrap_ari"), ((n % 17) / 100.0).alias("label_alignment_ari"), ((n % 13) / 100.0).alias("label_alignment_nmi"))
    return cl.verdict(df)


def _matrix(spark, sf_dir, modes=("strict", "hybrid")):
    from functools import reduce

    res = reduce(lambda a, b: a.unionByName(b), [results(spark, sf_dir, m, ("V1", "V4", "V5"), True, METRICS) for m in modes])
    compared = stage(cp.compare(res), "compared")
    return cr.detailed_matrix(compared, _capacity(compared))


_SHOW = ("dataset", "mode", "version", "effect_abs", "inverse_overlap", "separation_proxy", "is_usable", "utility_rank", "capacity_verdict")


def matrix(spark, sf_dir):
    """T01, K24."""
    return finish(_matrix(spark, sf_dir).select(*_SHOW, "confident_state_count", "likely_state_count", "no_evidence_for_above"))


def best(spark, sf_dir):
    """T02, T05."""
    return finish(cr.best_versions(_matrix(spark, sf_dir)).select(*_SHOW))


def best_mixed(spark, sf_dir):
    """T02, column-wise first non-null form."""
    return finish(cr.best_versions(_matrix(spark, sf_dir), mix_columns=True).select(*_SHOW))


def scenarios(spark, sf_dir):
    """T03, T04, T08."""
    m = _matrix(spark, sf_dir)
    df = cr.scenario_rows(m, spark, m.where("version = 'V4'")).join(cr.version_rows(spark), "version")
    return finish(df.select("dataset", "mode", "version", "availability_status", "dynamic_state", "status", "dynamic_supported", "needs_proxy"))


def confirmation(spark, sf_dir):
    """T06."""
    m = _matrix(spark, sf_dir)
    return finish(cr.state_confirmation(cr.scenario_rows(m, spark, m.where("version = 'V4'"))))


def strongest(spark, sf_dir):
    """The modes are ranked apart, so the strict rows need no others."""
    return finish(cr.strongest_strict(_matrix(spark, sf_dir, ("strict",))).select(*_SHOW))


def drill_down(spark, sf_dir):
    """T09."""
    return finish(cr.drill_down(features(spark, sf_dir)).withColumn("value", F.when(F.abs("value") > 1e-3, F.col("value"))))


QUERIES = {
    "l01_l02_base_calibration": base_calibration, "l09_subject_folds": folds, "l05_params_v5": _candidate_params("V5"), "l05_params_v7": _candidate_params("V7"),
    "l03_score_v5": _scores("V5"), "l04_score_v7": _scores("V7"), "l06_l08_l11_search_v5": _search("V5", "train"), "l11_search_v7_global": _search("V7", "global"),
    "l12_top_candidates": top_candidates, "l10_random_search": random_search,
    "t01_k24_matrix": matrix, "t02_t05_best": best, "t02_best_mixed": best_mixed, "t03_t04_t08_scenarios": scenarios, "t06_confirmation": confirmation,
    "t07_strongest_strict": strongest, "t09_drill_down": drill_down,
}
