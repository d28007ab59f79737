"""Registered queries: resource maps, version comparison, causal dynamics, what-if."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.operators import compare as cp
from tidemark.operators import dynamics as dy
from tidemark.operators import indices as ix
from tidemark.operators import resource as rs
from tidemark.operators import whatif as wi
from tidemark.plans.output import finish
from tidemark.plans.scoring import features
from tidemark.plans.staging import stage

L = F.lit


#: Columns of the results that the steps read: space of the measures, maps, quality metrics of the versions.
SPACE = ("segment_id", "dataset", "mode", "version", "label", "score", "A", "Gamma", "V", "Q")
METRICS = (*cp.KEYS, "label", "score", "Q", "arousal", "valence", *[f"{k}_{n}" for k in ("prov", "contrib") for n in cfg.COMPONENTS], *[f"sens_{n}" for n in cfg.SENSITIVITY_COMPONENTS])


def results(spark, sf_dir, mode="hybrid", versions=("V4", "V6"), sens=False, columns=None):
    """Scores of the versions, written once (all columns, or the named ones): every later step reads only its columns."""
    return stage(ix.evaluate_all(features(spark, sf_dir), mode, versions, sensitivities=sens, columns=columns), "results")


def flagship(spark, sf_dir):
    """Features -> V4 strict -> resource map -> quadrant counts by label."""
    return finish(rs.quadrants_by_label(rs.state_map(results(spark, sf_dir, "strict", ("V4",), columns=SPACE))))


def resource_score(spark, sf_dir):
    """R01 with R05: unsupported versions keep NULL."""
    df = rs.resource_columns(results(spark, sf_dir, "hybrid", ("V1", "V4", "V6"), columns=SPACE))
    return finish(df.select("segment_id", "version", "RES", "RES_core", "RES_mismatch", "RES_gamma_load"))


def state_map(spark, sf_dir):
    """Thresholds, quadrant, margin."""
    df = rs.state_map(results(spark, sf_dir, "hybrid", ("V1", "V4", "V6"), columns=SPACE))
    return finish(df.select("segment_id", "version", "score_threshold", "RES_threshold", "state_map_4", "state_map_margin"))


def quadrant_counts(spark, sf_dir):
    """R04."""
    return finish(rs.quadrants_by_label(rs.state_map(results(spark, sf_dir, columns=SPACE))))


def _mapped(spark, sf_dir):
    df = rs.resource_columns(results(spark, sf_dir, "hybrid", ("V5",), columns=SPACE))
    return df.where(F.col("RES").isNotNull()).select("segment_id", "dataset", "label", "score", "RES", "Q", "V")


def diamond_2d(spark, sf_dir):
    """R07 per dataset."""
    df = rs.diamond(_mapped(spark, sf_dir), {"i": "score", "r": "RES"}, ["dataset"])
    return finish(df.select("segment_id", "u_i", "u_r", "rho", "v_i", "v_r", "region", "confidence", "balance"))


def diamond_3d(spark, sf_dir):
    """R09 over the whole table."""
    df = rs.diamond(_mapped(spark, sf_dir), {"i": "score", "r": "RES", "d": "Q"}, [])
    return finish(df.select("segment_id", "u_i", "u_r", "u_d", "rho", "region", "confidence"))


def cell_grid(spark, sf_dir):
    """R08 on the 2-D diamond."""
    df = rs.diamond(_mapped(spark, sf_dir), {"i": "score", "r": "RES"}, ["dataset"])
    return finish(rs.cell_grid(df, ["u_i", "u_r"], "region", 0.5, ["dataset"]))


def octahedron(spark, sf_dir):
    """R11."""
    df = rs.octahedron_normalise(_mapped(spark, sf_dir), ["score", "RES", "Q"])
    return finish(df.select("segment_id", "o_score", "o_RES", "o_Q"))


def dynamic_axis(spark, sf_dir):
    """Tanh of weighted first and second differences and volatility."""
    df = rs.resource_columns(results(spark, sf_dir, "hybrid", ("V4",)))
    df = dy.dynamic_axis(dy.prepare(df), (0.8, 0.4, 0.2, 0.6))
    return finish(df.select("segment_id", "axis_d", "axis_d_differences"))


def version_metrics(spark, sf_dir):
    """C01-C09."""
    return finish(cp.version_metrics(results(spark, sf_dir, "hybrid", ("V1", "V4", "V5", "V6"), True, METRICS)))


def comparison(spark, sf_dir):
    """C10-C14."""
    df = cp.compare(results(spark, sf_dir, "proxy", ("V1", "V3", "V4", "V5"), True, METRICS))
    return finish(df.select("dataset", "mode", "version", "utility_score", "utility_rank", "oversmoothing_flag", "reliability_level"))


def rankings(spark, sf_dir):
    """C15."""
    return finish(cp.rankings(cp.compare(results(spark, sf_dir, "proxy", ("V1", "V3", "V4", "V5"), True, METRICS))))


def trajectories(spark, sf_dir):
    """C16."""
    df = dy.trajectories(results(spark, sf_dir, "hybrid", ("V4", "V5")))
    return finish(df.select("source_key", "segment_id", "version", "window_start_sec", "score", "rolling_mean", "rolling_median"))


def boxes(spark, sf_dir):
    """C17: box quantiles."""
    return finish(cp.box_quantiles(results(spark, sf_dir, "hybrid", ("V4", "V6"))))


def scatter(spark, sf_dir):
    """C17: scatter pairs."""
    return finish(cp.scatter_pairs(results(spark, sf_dir, "hybrid", ("V4",)), "valence", "Q"))


def scatter_points(spark, sf_dir):
    """The points of the scatter plots, at most 2,500 a dataset, mode and version."""
    return finish(cp.scatter_sample(cp.scatter_pairs(results(spark, sf_dir, "hybrid", ("V4", "V6")), "valence", "score"), cp.KEYS))


def availability(spark, sf_dir):
    """F19, both column lists."""
    df = features(spark, sf_dir)
    full = cp.feature_availability(df).withColumn("variant", L("full"))
    return finish(full.unionByName(cp.feature_availability(df, cfg.COMPARISON_FEATURES).withColumn("variant", L("comparison"))))


def _dynamic(spark, sf_dir):
    df = rs.state_map(results(spark, sf_dir, "hybrid", ("V4",)))
    return dy.dynamic_frame(dy.prepare(df, "V4"))


def dynamics_frames(spark, sf_dir):
    """Causal frames."""
    return finish(_dynamic(spark, sf_dir).select(
        "segment_id", "source_key", "time_sec", "delta_t_sec", "score_causal_mean", "score_causal_median", "score_volatility", "score_smooth_weight", "dscore_raw_dt"))


def dynamics_recurrences(spark, sf_dir):
    """EWMA family, stress drive, gains, asymmetric recurrence, dynamic quadrant."""
    return finish(_dynamic(spark, sf_dir).select(
        "segment_id", "score_ewma", "score_fast", "score_smooth_core", "RES_causal_mean", "RES_fast", "RES_dynamic", "stress_drive", "response_gain",
        "recovery_gain", "dynamic_mode", "score_dynamic", "state_map_4_dynamic", "dscore_dynamic_dt"))


def dynamics_selection(spark, sf_dir):
    """D02."""
    return finish(dy.select_records(dy.prepare(results(spark, sf_dir, "hybrid", ("V4",)), "V4")))


def dynamics_record(spark, sf_dir):
    """The dynamic rows of the largest selected record."""
    prepared = dy.prepare(results(spark, sf_dir, "hybrid", ("V4",)), "V4")
    top = dy.select_records(prepared).where(F.col("place") == 1).select("dataset", "source_key")
    rows = prepared.join(F.broadcast(top), ["dataset", "source_key"], "left_semi")
    return finish(dy.dynamic_frame(rows).select("dataset", "source_key", "segment_id", "time_sec", "score", "score_dynamic"))


def perturb_feature(spark, sf_dir):
    """Heart rate +15 over each record's default interval, rescored and re-run."""
    df = wi.perturb_feature(features(spark, sf_dir), "V4", "hybrid", "heart_rate", 15.0)
    return finish(df.drop("dataset", "mode", "version"))


def perturb_component(spark, sf_dir):
    """Gamma scaled by 1.3 in a fixed interval, V6 rescored from components."""
    df = wi.perturb_component(results(spark, sf_dir, "hybrid", ("V6",)), "V6", "Gamma", 0.3, operation="scale", start=86400.0, end=10 * 86400.0)
    return finish(df.drop("dataset", "mode", "version"))


def rescore(spark, sf_dir):
    """Rescoring from components for every version family."""
    from functools import reduce

    base = results(spark, sf_dir, "hybrid", ("V4",))
    parts = [wi.rescore(base, v).select("segment_id", L(v).alias("rescored_as"), "rescored") for v in ("V1", "V5", "V6", "V7")]
    return finish(reduce(lambda a, b: a.unionByName(b), parts))


QUERIES = {
    "flagship_quadrants": flagship,
    "r01_r05_resource_score": resource_score,
    "r02_r03_state_map": state_map,
    "r04_quadrants_by_label": quadrant_counts,
    "r07_diamond_2d": diamond_2d,
    "r08_cell_grid": cell_grid,
    "r09_diamond_3d": diamond_3d,
    "r10_dynamic_axis": dynamic_axis,
    "r11_octahedron": octahedron,
    "c01_c09_version_metrics": version_metrics,
    "c10_c14_utility": comparison,
    "c15_rankings": rankings,
    "c16_trajectories": trajectories,
    "c17_box_quantiles": boxes,
    "c17_scatter_pairs": scatter,
    "c17_k27_scatter_sample": scatter_points,
    "f19_availability": availability,
    "d01_d06_causal_frames": dynamics_frames,
    "d05_d11_recurrences": dynamics_recurrences,
    "d02_record_selection": dynamics_selection,
    "d12_record_rows": dynamics_record,
    "i01_i04_perturb_feature": perturb_feature,
    "i02_perturb_component": perturb_component,
    "i03_rescore": rescore,
}
