"""Registered queries for scoring primitives and index versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.functions import columns as fx
from tidemark.functions.structural import Spec, staged
from tidemark.operators import indices as ix
from tidemark.plans.output import finish
from tidemark.sources.tables import fixture

SCORE_COLUMNS = (
    ["segment_id", "version", "mode", "score", "raw_score", "coverage_ratio", "active_component_count"]
    + [x for n in cfg.COMPONENTS for x in (n, f"prov_{n}", f"source_{n}", f"contrib_{n}")]
)
L = F.lit


def features(spark, sf_dir) -> DataFrame:
    return fixture(spark, sf_dir, "fx_features")


def _version_query(version: str):
    def run(spark, sf_dir):
        parts = [ix.evaluate(features(spark, sf_dir), version, m, sensitivities=False) for m in cfg.MODES]
        both = reduce(DataFrame.unionByName, parts)
        return finish(both.select(*SCORE_COLUMNS, F.col("active_components").alias("active"), F.col("missing_components").alias("missing")))

    run.__doc__ = f"{version} over all three modes."
    return run


def mode_gate(spark, sf_dir):
    """Heart rate (proxy allowed) and gamma power (direct only) as each mode admits them."""
    df = features(spark, sf_dir)
    parts = []
    for m in cfg.MODES:
        v, p, s = fx.gated("heart_rate", m, allow_proxy=True)
        g, gp, _ = fx.gated("eeg_gamma_power", m)
        parts.append(df.select("segment_id", L(m).alias("mode"), v.alias("hr"), p.alias("hr_prov"), s.alias("hr_source"),
                               (g * 1e12).alias("gamma_uv2"), gp.alias("gamma_prov")))
    return finish(reduce(DataFrame.unionByName, parts))


def merge_traces(spark, sf_dir):
    """Merged provenance and source names of three features."""
    names = ("eeg_gamma_power", "heart_rate", "stress_label")
    return finish(features(spark, sf_dir).select(
        "segment_id",
        fx.merge_provenance([F.col(f"prov_{n}") for n in names]).alias("provenance"),
        fx.merge_sources([F.col(f"source_{n}") for n in names]).alias("sources"),
        fx.merge_provenance([F.col("prov_eeg_gamma_power"), F.col("prov_alpha_asymmetry")]).alias("eeg_provenance"),
    ))


def scalar_functions(spark, sf_dir):
    """P04-P10 on feature columns."""
    c = F.col
    return finish(features(spark, sf_dir).select(
        "segment_id",
        fx.sigmoid(c("valence") - 5).alias("logistic"), fx.gamma_log(c("eeg_gamma_power")).alias("gamma_log"),
        fx.ratio_log(c("hrv_hf_lf")).alias("ratio_log"), fx.bounded_gate(c("arousal") - 2).alias("gate"),
        fx.robust_tanh(c("heart_rate"), 100.0, 30.0).alias("centred"), fx.clip(c("hrv_hf_lf") - 1).alias("clipped"),
        fx.signed_power(c("hrv_hf_lf") - 3, 0.78).alias("signed_power"),
    ))


def softmax_gates(spark, sf_dir):
    """Multiplied-temperature softmax of an array."""
    c = F.col
    logits = F.array(c("valence") / 9, c("arousal") / 9, c("dominance") / 9)
    g = fx.softmax_array(logits, 1.65)
    return finish(features(spark, sf_dir).select("segment_id", *[g[i].alias(f"g{i}") for i in range(3)]))


_TERMS = ("a_term", "b_term", "c_term")


def _term_frame(spark, sf_dir):
    c = F.col
    return features(spark, sf_dir).select(
        "segment_id", "dataset",
        F.when(c("eeg_gamma_power").isNotNull(), (c("valence") - 5) / 4).alias("a_term"),
        ((c("hrv_hf_lf") - 3) / 3).alias("b_term"), ((c("heart_rate") - 100) / 50).alias("c_term"))


def structural_scalar(spark, sf_dir):
    """Structural scalar of up to three terms, missing terms dropped, dataset profile applied."""
    df = _term_frame(spark, sf_dir)
    df = staged(df, [Spec("scalar", _TERMS)], ix.v7_params(F.col("dataset")))
    return finish(df.select("segment_id", "scalar"))


def structural_frame(spark, sf_dir):
    """Frame form (missing = 0, never dropped) and gap-aware matrix form without the single-term rule."""
    df = _term_frame(spark, sf_dir)
    filled = df.withColumns({f"z_{t}": F.coalesce(F.col(t), L(0.0)) for t in _TERMS})
    params = ix.v7_params(F.col("dataset"))
    out = staged(filled, [Spec("frame_form", tuple(f"z_{t}" for t in _TERMS))], params, null_as_gap=False)
    out = staged(out, [Spec("matrix_form", _TERMS)], params, keep_single=False)
    return finish(out.select("segment_id", "frame_form", "matrix_form"))


def structural_trace(spark, sf_dir):
    """Every intermediate of the structural scalar."""
    df = staged(_term_frame(spark, sf_dir), [Spec("value", _TERMS)], ix.v7_params(F.col("dataset")), trace=True)
    names = ("n", "mean", "std", "level", "spread", "energy", "sign", "boost")
    return finish(df.select("segment_id", *[F.col(f"value_{n}").alias(n) for n in names], "value"))


def self_report_levels(spark, sf_dir):
    """Normalised self-report, motivation and stress levels, proxy ranges."""
    c = F.col
    mot, msrc = fx.motivation_level(c("dataset"), c("label"), c("valence"), c("stress_label"))
    st, ssrc = fx.stress_level(c("dataset"), c("label"), c("arousal"), c("stress_label"))
    return finish(features(spark, sf_dir).select(
        "segment_id", fx.self_report_norm(c("dataset"), c("valence")).alias("valence_norm"),
        fx.self_report_norm(c("dataset"), c("arousal")).alias("arousal_norm"),
        mot.alias("motivation"), msrc.alias("motivation_source"), st.alias("stress"), ssrc.alias("stress_source"),
        fx.level_in_range(mot, cfg.DOPAMINE_RANGE).alias("dopamine"), fx.level_in_range(st, cfg.CORTISOL_RANGE).alias("cortisol")))


def state_labels(spark, sf_dir):
    """State label from valence / arousal and numeric load of the label."""
    c = F.col
    load, prov, source = fx.stress_encoding(c("dataset"), c("label"), c("valence"), c("arousal"))
    derived, _, _ = fx.stress_encoding(c("dataset"), L("other"), c("valence"), c("arousal"))
    return finish(features(spark, sf_dir).select(
        "segment_id", fx.state_label(c("dataset"), c("valence"), c("arousal")).alias("state"),
        load.alias("load"), prov.alias("load_prov"), source.alias("load_source"), derived.alias("derived_load")))


def acceptance(spark, sf_dir):
    """Active and missing components, coverage, readiness and reason for V1 and V4."""
    df = features(spark, sf_dir)
    names = ("segment_id", "version", "mode", "coverage_ratio", "active_component_count", "active_components", "missing_components", "score", "insufficient_reason")
    parts = [ix.evaluate(df, v, m, sensitivities=False, columns=names) for v in ("V1", "V4") for m in cfg.MODES]
    return finish(reduce(DataFrame.unionByName, parts).select(
        "segment_id", "version", "mode", "coverage_ratio", "active_component_count", F.col("active_components").alias("active"),
        F.col("missing_components").alias("missing"), F.col("score").isNotNull().alias("scored"), "insufficient_reason"))


def explain(spark, sf_dir):
    """Top contributors per row."""
    df = ix.evaluate(features(spark, sf_dir), "V5", "hybrid", sensitivities=False)
    return finish(ix.top_contributors(df).select("segment_id", "top_contributors"))


def _sensitivity_query(version: str, mode: str):
    def run(spark, sf_dir):
        df = ix.evaluate(features(spark, sf_dir), version, mode)
        return finish(df.select("segment_id", "version", "score", *[f"sens_{n}" for n in cfg.SENSITIVITY_COMPONENTS]))

    return run


def all_versions(spark, sf_dir):
    """Seven versions stacked, summarised by version and label."""
    names = ("version", "mode", "label", "score", "raw_score", "coverage_ratio")
    df = ix.evaluate_all(features(spark, sf_dir), "proxy", sensitivities=False, columns=names)
    return finish(df.groupBy("version", "mode", "label").agg(
        F.count("score").alias("n"), F.avg("score").alias("mean_score"), F.avg("raw_score").alias("mean_raw"), F.avg("coverage_ratio").alias("mean_coverage")))


def provenance_counts(spark, sf_dir):
    """P25: provenance counts per version and component."""
    names = ("version", *[f"prov_{n}" for n in cfg.COMPONENTS])
    df = ix.evaluate_all(features(spark, sf_dir), "proxy", sensitivities=False, columns=names)
    return finish(ix.component_provenance(df))


def gate_trace(spark, sf_dir):
    """Logits, gates, levels, conflict, entropy and balance of the V6 and V7 mixtures."""
    out = []
    for version in ("V6", "V7"):
        df = ix.components(features(spark, sf_dir), version, "hybrid")
        src = {"a": "A", "g": "Gamma", "v": "V", "q": "Q"}
        if version == "V6":
            df = ix.regime_scores(df, {"b": src}, trace=True)
        else:
            df = ix.structural_regime_scores(df, {"b": src}, ix.v7_params(F.col("dataset")), trace=True)
        names = {"l0": "logit_reg", "l1": "logit_mob", "l2": "logit_dep", "g0": "gate_reg", "g1": "gate_mob", "g2": "gate_dep",
                 "reg": "level_reg", "mob": "level_mob", "dep": "level_dep", "conflict": "conflict", "entropy": "entropy", "balance": "balance"}
        out.append(df.select("segment_id", L(version).alias("version"), F.col("score_b").alias("score"),
                             *[F.col(f"b_{k}").alias(v) for k, v in names.items()]))
    return finish(reduce(DataFrame.unionByName, out))


def best_rows(spark, sf_dir):
    """Best example row per version."""
    df = ix.evaluate_all(features(spark, sf_dir), "hybrid", sensitivities=False)
    return finish(ix.best_examples(df).select("version", "segment_id", "score", "coverage_ratio", "active_component_count"))


QUERIES = {f"m0{v[1]}_index_{v.lower()}": _version_query(v) for v in cfg.VERSIONS} | {
    "p01_mode_gate": mode_gate,
    "p02_p03_merge_traces": merge_traces,
    "p04_p10_scalar_functions": scalar_functions,
    "p11_softmax": softmax_gates,
    "p12_structural_scalar": structural_scalar,
    "p13_structural_frame": structural_frame,
    "p14_p17_self_report_levels": self_report_levels,
    "s21_f17_state_labels": state_labels,
    "p18_p20_acceptance": acceptance,
    "p21_explain": explain,
    "p22_sensitivity_v1": _sensitivity_query("V1", "proxy"),
    "p22_sensitivity_v2": _sensitivity_query("V2", "strict"),
    "p22_sensitivity_v3": _sensitivity_query("V3", "proxy"),
    "p22_sensitivity_v4": _sensitivity_query("V4", "hybrid"),
    "p22_sensitivity_v5": _sensitivity_query("V5", "hybrid"),
    "p22_sensitivity_v6": _sensitivity_query("V6", "strict"),
    "p22_sensitivity_v7": _sensitivity_query("V7", "hybrid"),
    "p23_p24_all_versions": all_versions,
    "p25_component_provenance": provenance_counts,
    "m08_gate_trace": gate_trace,
    "m09_structural_trace": structural_trace,
    "m10_best_rows": best_rows,
}
