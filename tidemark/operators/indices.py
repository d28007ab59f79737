"""Index versions V1..V7: components, acceptance by mode, final score, sensitivities.

Every version is a chain of projections over one row: no shuffle, no Python workers. Values that
are used more than once get their own projection, so plans grow linearly with the formulas.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.functions import columns as fx
from tidemark.functions.structural import Spec, staged

L = F.lit
IDS = (
    "subject_id",
    "segment_id",
    "dataset",
    "label",
    "source_record_id",
    "window_start_sec",
    "window_end_sec",
    "segment_duration_sec",
)
REPORT = ("stress_label", "valence", "arousal", "dominance", "liking")

NOTES = {
    "V1": "logistic of the weighted sum of A, Gamma, H, V; A from alpha asymmetry",
    "V2": "logistic of the weighted sum of A, Gamma, H, V; A from total power asymmetry",
    "V3": "as V2 with H scaled by the permeability coefficient K",
    "V4": "logistic of .10 A - .05 Gamma + .25 V + .60 Q on calibrated components",
    "V5": "mix of the logistic core and a contrast layer",
    "V6": "soft mixture of regulation, mobilisation and depletion regimes",
    "V7": "regime mixture over structural scalars with a profile per dataset",
}
REASON_ALL = "the mode needs every component of the version"
REASON_NONE = "no component can be used"


def v7_params(dataset: Column) -> dict[str, Column]:
    """V7 parameters as columns: dataset profile over the defaults, as CASE expressions."""
    key = F.lower(F.trim(dataset))
    return {
        name: fx.by_key(key, {d: p[name] for d, p in cfg.V7_BY_DATASET.items() if name in p}, L(float(value)))
        for name, value in cfg.V7.items()
    }


def _with_params(df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Evaluates the dataset profile once per row and hands out plain column references."""
    names = {name: f"v7_{name}" for name in cfg.V7}
    if "v7_temperature" not in df.columns:
        df = df.withColumns({names[k]: v for k, v in v7_params(F.col("dataset")).items()})
    return df, {k: F.col(c) for k, c in names.items()}


# --- components ---------------------------------------------------------------------------------

_USED = {
    "V1": {"eeg_alpha_left": False, "eeg_alpha_right": False, "eeg_gamma_power": False,
           "hrv_hf": True, "hrv_lf": True, "hrv_hf_lf": True},
    "V2": {"eeg_left_power": False, "eeg_right_power": False, "eeg_alpha_left": False, "eeg_alpha_right": False,
           "eeg_gamma_power": False, "hrv_hf": True, "hrv_lf": True, "hrv_hf_lf": True},
    "V4": {"alpha_asymmetry": False, "eeg_left_power": False, "eeg_right_power": False, "eeg_gamma_power": False,
           "gamma_alpha_ratio": False, "heart_rate": True, "hrv_hf_lf": True},
}
_USED["V3"] = _USED["V2"]
for _v in ("V5", "V6", "V7"):
    _USED[_v] = _USED["V4"]


def gate_features(df: DataFrame, version: str, mode: str) -> DataFrame:
    """Applies the mode gate to the features a version reads: g_x, gp_x (provenance), gs_x (source)."""
    out = {}
    for name, allow_proxy in _USED[version].items():
        value, prov, source = fx.gated(name, mode, allow_proxy)
        out |= {f"g_{name}": value, f"gp_{name}": prov, f"gs_{name}": source}
    return df.withColumns(out)


def _g(name: str) -> Column:
    return F.col(f"g_{name}")


def _trace(names: list[str], guard: Column | None = None) -> tuple[list[Column], list[Column]]:
    """Provenance and source columns of features; counted only where the guard holds."""
    keep = lambda c: c if guard is None else F.when(guard, c)
    return [keep(F.col(f"gp_{n}")) for n in names], [keep(F.col(f"gs_{n}")) for n in names]


def _put(name: str, value: Column, provs: list[Column], sources: list[Column]) -> dict:
    """A component with the traces of its parts, to be placed by ``_assign``."""
    return {name: (value, provs, sources)}


def _assign(df: DataFrame, cols: dict) -> DataFrame:
    """Adds values first and then provenance and source, so that no value is computed twice."""
    df = df.withColumns({n: c[0] if isinstance(c, tuple) else c for n, c in cols.items()})
    traces = {}
    for n, c in cols.items():
        if isinstance(c, tuple):
            known = F.col(n).isNotNull()
            traces[f"prov_{n}"] = F.when(known, fx.merge_provenance(c[1])).otherwise("unavailable")
            traces[f"source_{n}"] = F.when(known, fx.merge_sources(c[2])).otherwise("")
    return df.withColumns(traces) if traces else df


def _absent(name: str) -> dict[str, Column]:
    return {name: fx.null_double(), f"prov_{name}": L("unavailable"), f"source_{name}": L("")}


def _hormones(df: DataFrame, mode: str) -> DataFrame:
    """Proxy levels of the two hormone terms; present only in proxy mode."""
    if mode != "proxy":
        return df.withColumns({
            "x_dopamine": fx.null_double(), "x_dopamine_src": fx.null_string(),
            "x_cortisol": fx.null_double(), "x_cortisol_src": fx.null_string(),
        })
    d, lab, s = F.col("dataset"), F.col("label"), F.col("stress_label")
    motivation, m_src = fx.motivation_level(d, lab, F.col("valence"), s)
    stress, s_src = fx.stress_level(d, lab, F.col("arousal"), s)
    return df.withColumns({
        "x_dopamine": fx.level_in_range(motivation, cfg.DOPAMINE_RANGE), "x_dopamine_src": m_src,
        "x_cortisol": fx.level_in_range(stress, cfg.CORTISOL_RANGE), "x_cortisol_src": s_src,
    })


def _early_components(df: DataFrame, version: str, mode: str) -> DataFrame:
    """Components of V1, V2 and V3."""
    df = _hormones(gate_features(df, version, mode), mode)
    hf, lf, ratio = _g("hrv_hf"), _g("hrv_lf"), _g("hrv_hf_lf")
    both = hf.isNotNull() & lf.isNotNull()
    v_prov, v_src = _trace(["hrv_hf", "hrv_lf"], both)
    r_prov, r_src = _trace(["hrv_hf_lf"], ~both)
    alpha_pair = ["eeg_alpha_left", "eeg_alpha_right"]
    a_pair = alpha_pair if version == "V1" else ["eeg_left_power", "eeg_right_power"]
    q = F.tanh(L(cfg.PERMEABILITY["valence_beta"]) * fx.asymmetry(_g(alpha_pair[0]), _g(alpha_pair[1])))
    cols = (
        _put("A", fx.asymmetry(_g(a_pair[0]), _g(a_pair[1])), *_trace(a_pair))
        | _put("Gamma", fx.gamma_log(_g("eeg_gamma_power")), *_trace(["eeg_gamma_power"]))
        | _put("V", F.when(both, fx.ratio_log(hf / (lf + L(cfg.EPSILON)))).otherwise(fx.ratio_log(ratio)),
               v_prov + r_prov, v_src + r_src)
        | _put("Q", q, *_trace(alpha_pair))
    )
    if version == "V3" and mode == "proxy":
        df = df.withColumns({
            "x_r": fx.clip(F.when(ratio.isNotNull(), ratio / (L(1.0) + ratio)).otherwise(hf / (L(1.0) + hf))),
            "x_g": fx.bounded_gate(fx.gamma_log(_g("eeg_gamma_power"))),
            "x_s": fx.clip((F.col("x_cortisol") - L(8.0)) / L(17.0)),
        })
        p = cfg.PERMEABILITY
        fatigue = fx.sigmoid(L(p["fatigue_k"]) * (F.col("x_s") - L(p["fatigue_s0"])))
        load = L(1.0) + L(p["alpha"]) * F.col("x_s") * F.col("x_s") + L(p["beta"]) * fatigue
        ready = hf.isNotNull() & _g("eeg_gamma_power").isNotNull() & F.col("x_cortisol").isNotNull()
        provs, sources = _trace(["hrv_hf", "eeg_gamma_power", "hrv_hf_lf"])
        cols |= _put("K", F.when(ready, F.col("x_r") * F.col("x_g") / load),
                     provs + [L("proxy")], [sources[0], sources[1], F.col("x_cortisol_src"), sources[2]])
    else:
        cols |= _absent("K")
    df = _assign(df, cols)
    gain = F.col("K") if version == "V3" else L(1.0)
    h = gain * F.col("x_dopamine") / L(50.0) - F.col("x_cortisol") / L(15.0)
    sources = [F.col("x_dopamine_src"), F.col("x_cortisol_src")]
    if version == "V3":
        sources = [F.col("source_K")] + sources
    return _assign(df, _put("H", h, [L("proxy")], sources))


def _calibrated_terms(df: DataFrame) -> DataFrame:
    """The six centred tanh terms shared by V4..V7."""
    t = lambda x, key: fx.robust_tanh(x, *cfg.CALIBRATION[key])
    hr_center, hr_width = cfg.CALIBRATION["heart_rate"]
    return df.withColumns({
        "t_alpha": t(_g("alpha_asymmetry"), "alpha_asymmetry"),
        "t_total": t(fx.asymmetry(_g("eeg_left_power"), _g("eeg_right_power")), "total_asymmetry"),
        "t_gamma": t(fx.gamma_log(_g("eeg_gamma_power")), "gamma_log"),
        "t_burden": t(F.log1p(fx.positive(_g("gamma_alpha_ratio"))), "gamma_alpha_log"),
        "t_hr": fx.robust_tanh(L(hr_center) - _g("heart_rate"), 0.0, hr_width),
        "t_hrv": t(fx.ratio_log(_g("hrv_hf_lf")), "hf_lf_log"),
    })


def _traces_agv() -> dict[str, tuple[list[Column], list[Column]]]:
    lr = _g("eeg_left_power").isNotNull() & _g("eeg_right_power").isNotNull()
    pa, sa = _trace(["alpha_asymmetry"])
    pt, st = _trace(["eeg_left_power", "eeg_right_power"], lr)
    return {
        "A": (pa + pt, sa + st),
        "Gamma": _trace(["eeg_gamma_power", "gamma_alpha_ratio"]),
        "V": _trace(["heart_rate", "hrv_hf_lf"]),
    }


def _anchor(df: DataFrame, mode: str) -> tuple[Column, Column, Column]:
    """Normalised valence and arousal and whether the proxy anchor applies."""
    val = fx.self_report_norm(F.col("dataset"), F.col("valence"))
    aro = fx.self_report_norm(F.col("dataset"), F.col("arousal"))
    if mode != "proxy":
        return val, aro, L(False)
    return val, aro, val.isNotNull() & aro.isNotNull()


def _finish_q(df: DataFrame, mode: str, q_phys: Column, anchor, weight: Column, *, anchor_alone: bool, guard: Column) -> DataFrame:
    """Blends the physiological Q with the self-report anchor and attaches provenance.

    anchor_alone: with no physiological part the anchor itself becomes Q (V4, V5); otherwise Q
    stays missing. guard: some component exists, which decides between a value without number
    and an unavailable component.
    """
    val, aro, anchored = _anchor(df, mode)
    base_prov = fx.merge_provenance([F.col(f"prov_{c}") for c in ("A", "Gamma", "V")])
    order = ("A", "V", "Gamma") if anchor_alone == "avg" else ("A", "Gamma", "V")
    base_src = fx.merge_sources([F.col(f"source_{c}") for c in order])
    df = df.withColumns({"q_phys": q_phys, "q_src": base_src})
    q = F.col("q_phys")
    blended = (L(1.0) - weight) * q + weight * anchor(val, aro)
    if anchor_alone:
        blended = F.coalesce(blended, anchor(val, aro))
    value = F.when(anchored, blended).otherwise(q)
    df = df.withColumns({"Q": value})
    live = F.col("Q").isNotNull() if anchor_alone else guard
    val, aro, anchored = _anchor(df, mode)
    return df.withColumns({
        "prov_Q": F.when(~live, "unavailable").when(anchored, "proxy").otherwise(base_prov),
        "source_Q": F.when(~live, "")
        .when(anchored, fx.merge_sources_text(F.col("q_src"), ["valence", "arousal"]))
        .otherwise(F.col("q_src")),
    })


def _modern_components(df: DataFrame, version: str, mode: str) -> DataFrame:
    """Components of V4, V5 and V6: shared A, Gamma, V and a Q per version."""
    df = _calibrated_terms(gate_features(df, version, mode))
    a = F.tanh(fx.null_sum([L(1.10) * F.col("t_alpha"), L(0.40) * F.col("t_total")]))
    gamma = F.tanh(fx.null_sum([L(0.30) * F.col("t_gamma"), L(0.70) * F.col("t_burden")]))
    v = F.coalesce(F.tanh(L(0.80) * F.col("t_hr") + L(0.20) * F.col("t_hrv")), F.col("t_hr"), F.col("t_hrv"))
    tr = _traces_agv()
    df = _assign(df, _put("A", a, *tr["A"]) | _put("Gamma", gamma, *tr["Gamma"]) | _put("V", v, *tr["V"]) | _absent("H") | _absent("K"))
    some = F.col("A").isNotNull() | F.col("Gamma").isNotNull() | F.col("V").isNotNull()
    if version == "V4":
        q = F.tanh(fx.null_sum([L(0.55) * F.col("A"), L(0.45) * F.col("V"), L(-0.25) * F.col("Gamma")]))
        anchor = lambda val, aro: F.tanh(L(2.2) * (L(0.62) * val + L(0.38) * (L(1.0) - aro) - L(0.5)))
        return _finish_q(df, mode, q, anchor, L(cfg.V4_PROXY_WEIGHT), anchor_alone="avg", guard=some)
    if version == "V5":
        return _q_contrast(df, mode, some)
    return _q_regimes(df, mode, some)


def contrast_q(df: DataFrame, lin: Column, p: dict[str, Column]) -> tuple[DataFrame, Column]:
    """V5 physiological Q from A, Gamma, V; missing parts count as 0."""
    a, g, v, zero = F.col("A"), F.col("Gamma"), F.col("V"), L(0.0)
    df = df.withColumns({
        "q_lin": lin,
        "q_a": fx.signed_power(a, p["q_signed_power"]),
        "q_v": fx.signed_power(v, p["q_signed_power"]),
        "q_g": fx.signed_power(g, 1.05),
        "q_coh": F.coalesce(a * v - p["q_mismatch_penalty"] * F.abs(a - v), zero)
        - p["q_gamma_penalty"] * F.coalesce(fx.positive(g), zero),
    })
    qa, qv, qg = F.col("q_a"), F.col("q_v"), F.col("q_g")
    conflict = F.coalesce(F.abs(qa - qv), zero) + F.coalesce(
        p["q_gamma_v_penalty"] * fx.positive(qg) * (L(1.0) - fx.positive(qv)), zero
    )
    energy = F.coalesce(L(0.5) * (F.abs(qa) + F.abs(qv)), zero)
    q = F.tanh(
        p["q_linear_gain"] * F.col("q_lin")
        + p["q_coherence_gain"] * F.col("q_coh")
        + p["q_synergy_gain"] * F.coalesce(fx.signed_root(qa, qv), zero)
        + p["q_energy_gain"] * energy * F.signum(F.col("q_lin"))
        - p["q_conflict_gain"] * conflict
    )
    return df, q


V5_PARAMS = {k: v for k, v in cfg.V5.items()}


def v5_params() -> dict[str, Column]:
    return {k: L(float(v)) for k, v in V5_PARAMS.items()}


def _q_contrast(df: DataFrame, mode: str, some: Column) -> DataFrame:
    lin = fx.null_sum([L(0.50) * F.col("A"), L(0.42) * F.col("V"), L(-0.30) * F.col("Gamma")])
    df, q = contrast_q(df, lin, v5_params())
    anchor = lambda val, aro: F.tanh(L(2.4) * (L(0.65) * val + L(0.35) * (L(1.0) - aro) - L(0.5)))
    return _finish_q(df, mode, q, anchor, L(cfg.V5["q_proxy_weight"]), anchor_alone=True, guard=some)


def shaped(prefix: str, a: Column, g: Column, v: Column, q: Column | None = None) -> dict[str, Column]:
    """Signed-power shapes of the components; missing ones enter as 0."""
    z = lambda c: F.coalesce(c, L(0.0))
    out = {
        f"{prefix}a": fx.signed_power(z(a), cfg.V6["shape_power"]),
        f"{prefix}g": fx.signed_power(z(g), cfg.V6["gamma_shape_power"]),
        f"{prefix}v": fx.signed_power(z(v), cfg.V6["shape_power"]),
        f"{prefix}p": fx.positive(fx.signed_power(z(g), cfg.V6["gamma_shape_power"])),
    }
    if q is not None:
        out[f"{prefix}q"] = fx.signed_power(z(q), cfg.V6["shape_power"])
    return out


def _q_regimes(df: DataFrame, mode: str, some: Column) -> DataFrame:
    p = cfg.V6
    df = df.withColumns(shaped("s_", F.col("A"), F.col("Gamma"), F.col("V")))
    a, v, gp = F.col("s_a"), F.col("s_v"), F.col("s_p")
    df = df.withColumns({
        "q_l0": L(0.95) * a + L(1.05) * v - L(0.55) * gp,
        "q_l1": L(-0.18) * a + L(0.48) * v - L(1.05) * gp,
        "q_l2": L(-0.80) * a - L(0.95) * v + L(0.72) * gp,
        "q_reg": L(p["reg_q_base"]) + L(p["reg_q_amp"])
        * F.tanh(L(1.10) * a + L(1.15) * v - L(0.45) * gp + L(0.30) * fx.signed_root(a, v)),
        "q_mob": L(p["mob_q_base"]) + L(p["mob_q_amp"]) * F.tanh(L(0.10) * a + L(0.55) * v - L(1.20) * gp),
        "q_dep": L(p["dep_q_base"]) + L(p["dep_q_amp"])
        * F.tanh(L(-0.65) * F.abs(a) - L(0.95) * F.abs(v) + L(0.95) * gp),
    })
    weights = fx.softmax_terms([F.col("q_l0"), F.col("q_l1"), F.col("q_l2")], L(p["gate_temperature"]))
    df = df.withColumns({f"q_w{i}": w for i, w in enumerate(weights)})
    w = [F.col(f"q_w{i}") for i in range(3)]
    mixed = (w[0] * F.col("q_reg") + w[1] * F.col("q_mob") + w[2] * F.col("q_dep")) / (w[0] + w[1] + w[2])
    anchor = lambda val, aro: fx.clip(L(0.70) * val + L(0.30) * (L(1.0) - aro))
    return _finish_q(df, mode, F.when(some, fx.clip(mixed)), anchor, L(p["q_proxy_weight"]), anchor_alone=False, guard=some)


def _structural_components(df: DataFrame, mode: str) -> DataFrame:
    """Components of V7: every component is the structural scalar of its weighted terms."""
    df = _calibrated_terms(gate_features(df, "V7", mode))
    df, params = _with_params(df)
    c = F.col
    df = df.withColumns({
        "k_a0": c("t_alpha"), "k_a1": L(0.55) * c("t_total"), "k_a2": L(0.35) * fx.signed_root(c("t_alpha"), c("t_total")),
        "k_g0": L(0.35) * c("t_gamma"), "k_g1": L(0.75) * c("t_burden"),
        "k_g2": L(0.20) * fx.signed_root(c("t_gamma"), c("t_burden")),
        "k_v0": L(0.85) * c("t_hr"), "k_v1": L(0.30) * c("t_hrv"), "k_v2": L(0.20) * fx.signed_root(c("t_hr"), c("t_hrv")),
    })
    df = staged(df, [Spec(f"r_{k}", tuple(f"k_{k}{i}" for i in range(3))) for k in "agv"], params)
    tr = _traces_agv()
    cols = {}
    for name, key in (("A", "a"), ("Gamma", "g"), ("V", "v")):
        cols |= _put(name, F.tanh(params["component_gain"] * c(f"r_{key}")), *tr[name])
    df = _assign(df, cols | _absent("H") | _absent("K"))
    a, g, v = c("A"), c("Gamma"), c("V")
    some = a.isNotNull() | g.isNotNull() | v.isNotNull()
    df = df.withColumns({
        "q0": L(0.52) * a + L(0.44) * v - L(0.32) * g,
        "q1": a * v - params["q_coherence_penalty"] * F.abs(a - v) - params["q_gamma_penalty"] * fx.positive(g),
    })
    df = df.withColumns({"q2": L(0.55) * fx.signed_root(c("q0"), c("q1"))})
    df = staged(df, [Spec("r_q", ("q0", "q1", "q2"))], params)
    q = fx.clip(L(0.5) + L(0.5) * F.tanh(params["q_gain"] * c("r_q")))
    anchor = lambda val, aro: fx.clip(L(0.65) * val + L(0.35) * (L(1.0) - aro))
    return _finish_q(df, mode, q, anchor, params["q_proxy_weight"], anchor_alone=False, guard=some)


def components(features: DataFrame, version: str, mode: str) -> DataFrame:
    """Adds A, Gamma, H, V, Q, K with prov_ and source_ columns to a feature table."""
    if version in ("V1", "V2", "V3"):
        return _early_components(features, version, mode)
    if version == "V7":
        return _structural_components(features, mode)
    return _modern_components(features, version, mode)


# --- final score --------------------------------------------------------------------------------

def direction(component: str, version: str) -> float:
    return -1.0 if component == "Gamma" and version in ("V4", "V5", "V6", "V7") else 1.0


def regime_scores(df: DataFrame, probes: dict[str, dict[str, str]], *, trace: bool = False) -> DataFrame:
    """V6 regime mixture for several input sets at once; probe name -> columns for a, g, v, q.

    Adds score_<probe> (before clipping is clipped to 0..1); trace keeps the intermediates.
    """
    p = cfg.V6
    cols, scratch = {}, []
    for name, src in probes.items():
        cols |= shaped(f"{name}_s", F.col(src["a"]), F.col(src["g"]), F.col(src["v"]), F.col(src["q"]))
    scratch += list(cols)
    df = df.withColumns(cols)
    cols = {}
    for name in probes:
        a, v, q, gp = (F.col(f"{name}_s{k}") for k in "avqp")
        cols |= {
            f"{name}_l0": L(0.60) * q + L(0.45) * v + L(0.15) * a - L(0.30) * gp,
            f"{name}_l1": L(-0.05) * q + L(0.20) * v - L(0.55) * gp - L(0.08) * a,
            f"{name}_l2": L(-0.70) * q - L(0.55) * v - L(0.20) * a + L(0.35) * gp,
            f"{name}_reg": L(p["reg_score_base"]) + L(p["reg_score_amp"]) * F.tanh(
                L(0.75) * q + L(0.55) * v + L(0.18) * a - L(0.25) * gp + L(0.25) * fx.signed_root(q, v)),
            f"{name}_mob": L(p["mob_score_base"]) + L(p["mob_score_amp"]) * F.tanh(
                L(-0.08) * q + L(0.32) * v - L(0.52) * gp + L(0.08) * a),
            f"{name}_dep": L(p["dep_score_base"]) + L(p["dep_score_amp"]) * F.tanh(
                L(-0.62) * q - L(0.52) * v - L(0.18) * a + L(0.38) * gp),
            f"{name}_conflict": F.abs(a - v) + L(0.75) * F.abs(q - v),
        }
    scratch += list(cols)
    df = df.withColumns(cols)
    params = {k: L(float(val)) for k, val in p.items()}
    return _mixture(df, list(probes), params, scratch, trace)


def structural_regime_scores(
    df: DataFrame, probes: dict[str, dict[str, str]], params: dict[str, Column], *,
    keep_single: bool = True, trace: bool = False,
) -> DataFrame:
    """V7 regime mixture: regime signatures are structural scalars of the shaped components."""
    cols, scratch = {}, []
    for name, src in probes.items():
        cols |= shaped(f"{name}_s", F.col(src["a"]), F.col(src["g"]), F.col(src["v"]), F.col(src["q"]))
    scratch += list(cols)
    df = df.withColumns(cols)
    cols, specs = {}, []
    for name in probes:
        a, v, q, gp = (F.col(f"{name}_s{k}") for k in "avqp")
        terms = {
            "l0": [L(0.72) * q, L(0.52) * v, L(0.18) * a, L(-0.24) * gp],
            "l1": [L(-0.06) * q, L(0.28) * v, L(-0.48) * gp, L(0.10) * a],
            "l2": [L(-0.60) * q, L(-0.50) * v, L(0.36) * gp, L(-0.20) * a],
        }
        for key, parts in terms.items():
            cols |= {f"{name}_{key}t{i}": x for i, x in enumerate(parts)}
            specs.append(Spec(f"{name}_{key}", tuple(f"{name}_{key}t{i}" for i in range(4))))
    df = staged(df.withColumns(cols), specs, params, keep_single=keep_single, null_as_gap=False).drop(*cols)
    cols = {}
    for name in probes:
        a, v, q = (F.col(f"{name}_s{k}") for k in "avq")
        cols |= {
            f"{name}_reg": params["reg_score_base"] + params["reg_score_amp"] * F.tanh(
                F.col(f"{name}_l0") + L(0.20) * fx.signed_root(q, v)),
            f"{name}_mob": params["mob_score_base"] + params["mob_score_amp"] * F.tanh(F.col(f"{name}_l1")),
            f"{name}_dep": params["dep_score_base"] + params["dep_score_amp"] * F.tanh(F.col(f"{name}_l2")),
            f"{name}_conflict": F.abs(a - v) + L(0.65) * F.abs(q - v),
        }
    scratch += list(cols) + [s.out for s in specs]
    return _mixture(df.withColumns(cols), list(probes), params, scratch, trace)


def _mixture(df: DataFrame, names: list[str], params: dict[str, Column], scratch: list[str], trace: bool) -> DataFrame:
    """Softmax-gated mixture of the three regime levels less entropy and conflict."""
    cols = {}
    for n in names:
        for i, w in enumerate(fx.softmax_terms([F.col(f"{n}_l{i}") for i in range(3)], params["gate_temperature"])):
            cols[f"{n}_w{i}"] = w
    df = df.withColumns(cols)
    gates = {}
    for n in names:
        mass = fx.total([F.col(f"{n}_w{i}") for i in range(3)])
        gates |= {f"{n}_g{i}": F.col(f"{n}_w{i}") / mass for i in range(3)}
    df = df.withColumns(gates)
    scores, extra = {}, {}
    for n in names:
        g = [F.col(f"{n}_g{i}") for i in range(3)]
        entropy = -fx.total([x * F.ln(x + L(1e-9)) for x in g]) / L(math.log(3.0))
        level = g[0] * F.col(f"{n}_reg") + g[1] * F.col(f"{n}_mob") + g[2] * F.col(f"{n}_dep")
        scores[f"score_{n}"] = fx.clip(
            level
            - params["transition_entropy_weight"] * entropy
            + params["regime_balance_weight"] * (g[0] - g[2])
            - params["conflict_penalty"] * F.col(f"{n}_conflict")
        )
        extra[f"{n}_entropy"] = entropy
        extra[f"{n}_balance"] = g[0] - g[2]
    if trace:
        return df.withColumns(scores | extra)
    return df.withColumns(scores).drop(*scratch, *cols, *gates)


def contrast_scores(df: DataFrame, probes: dict[str, dict[str, str]], params: dict[str, Column] | None = None) -> DataFrame:
    """V5 mix of logistic core and contrast layer; probe columns: a, g, v, q and the linear core."""
    p, cols, scratch = params or v5_params(), {}, []
    for n, src in probes.items():
        z = lambda key: F.coalesce(F.col(src[key]), L(0.0))
        cols |= {f"{n}_{k}": fx.signed_power(z(k), p["output_signed_power"]) for k in ("a", "v", "q")}
        cols |= {f"{n}_vr": z("v"), f"{n}_qr": z("q"), f"{n}_gr": z("g")}
    scratch += list(cols)
    df = df.withColumns(cols)
    cols = {}
    for n in probes:
        a, v, q = (F.col(f"{n}_{k}") for k in ("a", "v", "q"))
        cols |= {
            f"{n}_ctr": L(0.14) * a - L(0.08) * F.col(f"{n}_gr") + L(0.22) * v + L(0.56) * q - p["output_center"],
            f"{n}_syn": fx.signed_root(a, v) + L(0.8) * fx.signed_root(q, v),
            f"{n}_cfl": F.abs(a - v) + L(0.75) * F.abs(q - v),
            f"{n}_nrg": F.sqrt((a * a + v * v + q * q) / L(3.0)),
        }
    scratch += list(cols)
    df = df.withColumns(cols)
    cols = {}
    for n, src in probes.items():
        ctr, syn, cfl, nrg = (F.col(f"{n}_{k}") for k in ("ctr", "syn", "cfl", "nrg"))
        brake = fx.positive(F.col(f"{n}_gr"))
        drive = (
            p["output_gain"] * ctr
            + p["output_curve"] * ctr * ctr * ctr
            + p["output_balance_coupling"] * (F.col(f"{n}_qr") - F.col(f"{n}_vr"))
            - p["output_gamma_brake"] * brake
            + p["output_regime_gain"] * syn
            + p["output_energy_gain"] * nrg * F.signum(ctr)
            - p["output_conflict_gain"] * cfl
            - p["output_gamma_cross_penalty"] * brake * (L(1.0) - fx.positive(F.col(f"{n}_vr")))
        )
        base = fx.sigmoid(F.col(src["core"]) + L(0.22) * syn - L(0.10) * cfl)
        mix = p["output_contrast_mix"]
        cols[f"score_{n}"] = fx.clip((L(1.0) - mix) * base + mix * (L(0.5) + L(0.5) * F.tanh(drive)))
    return df.withColumns(cols).drop(*scratch)


def evaluate(features: DataFrame, version: str, mode: str, *, sensitivities: bool = True, columns=None) -> DataFrame:
    """Scores one version over a feature table: the results table of the library.

    ``columns`` names the result columns that are wanted. What no other column needs is then not computed: the planner
    drops it below the fence, but not above.
    """
    df = components(features, version, mode)
    weights = cfg.WEIGHTS[version]
    required = list(weights)
    c = F.col

    df = df.withColumns({f"u_{n}": fx.accepted(c(n), c(f"prov_{n}"), mode) for n in required})
    live = {n: c(f"u_{n}").isNotNull() for n in required}
    active_weight = fx.total([F.when(live[n], L(weights[n])).otherwise(L(0.0)) for n in required])
    count = fx.total([live[n].cast("int") for n in required])
    total_weight = sum(weights.values())
    df = df.withColumns({
        "active_weight": active_weight,
        "coverage_ratio": active_weight / L(total_weight),
        "active_component_count": count,
    })
    ready = c("active_component_count") == len(required) if mode != "hybrid" else c("active_component_count") > 0
    norm = c("active_weight") if mode == "hybrid" else L(1.0)
    df = df.withColumns({f"lin_{n}": F.when(ready, L(direction(n, version) * weights[n]) / norm * c(f"u_{n}")) for n in required})
    core = F.when(ready, fx.total([F.coalesce(c(f"lin_{n}"), L(0.0)) for n in required]))

    probe_names = ["b"]
    perturbed = [n for n in cfg.SENSITIVITY_COMPONENTS if n in required] if sensitivities else []
    for n in perturbed:
        df = df.withColumns({
            f"dx_{n}": F.greatest(F.abs(c(f"u_{n}")) * L(cfg.SENSITIVITY_DELTA), L(cfg.SENSITIVITY_FLOOR)),
        })
        probe_names.append(n)
    df = df.withColumns({"core_b": core})
    df = df.withColumns({
        f"core_{n}": c("core_b") + L(direction(n, version) * weights[n]) / norm * c(f"dx_{n}") for n in perturbed
    } | {f"up_{n}": c(f"u_{n}") + c(f"dx_{n}") for n in perturbed})

    if version in ("V1", "V2", "V3", "V4"):
        df = df.withColumns({f"score_{n}": fx.clip(fx.sigmoid(c(f"core_{n}"))) for n in probe_names})
        raw, contrib = c("core_b"), {n: c(f"lin_{n}") for n in required}
    else:
        key = {"A": "a", "Gamma": "g", "V": "v", "Q": "q"}
        base = {key[n]: f"u_{n}" for n in required}
        probes = {"b": base | {"core": "core_b"}}
        for n in perturbed:
            probes[n] = base | {key[n]: f"up_{n}", "core": f"core_{n}"}
        z = lambda name: F.coalesce(c(name), L(0.0))
        if version == "V5":
            df = contrast_scores(df, probes)
            raw, contrib = c("core_b"), {n: c(f"lin_{n}") for n in required}
        elif version == "V6":
            df = regime_scores(df, probes)
            power = {n: cfg.V6["gamma_shape_power" if n == "Gamma" else "shape_power"] for n in required}
            contrib = {n: F.when(ready, L(direction(n, "V6") * weights[n]) * fx.signed_power(z(f"u_{n}"), power[n])) for n in required}
            raw = fx.total([contrib[n] for n in required])
        else:
            df, params = _with_params(df)
            df = structural_regime_scores(df, probes, params)
            own = {
                n: fx.by_key(F.lower(F.trim(c("dataset"))), {d: w[n] for d, w in cfg.V7_WEIGHTS_BY_DATASET.items()}, L(weights[n]))
                for n in required
            }
            contrib = {n: F.when(ready, L(direction(n, "V7")) * own[n] * z(f"u_{n}")) for n in required}
            raw = fx.total([contrib[n] for n in required])

    df = df.withColumns({f"contrib_{n}": contrib.get(n, fx.null_double()) for n in cfg.COMPONENTS} | {"raw_score": raw})
    active = F.array_compact(F.array(*[F.when(live[n], L(n)) for n in required]))
    missing = F.array_compact(F.array(*[F.when(~live[n], L(n)) for n in required]))
    score = F.when(ready, c("score_b"))
    sens = {
        f"sens_{n}": F.when(ready & live[n], (c(f"score_{n}") - c("score_b")) / c(f"dx_{n}")) if n in perturbed else fx.null_double()
        for n in cfg.SENSITIVITY_COMPONENTS
    }
    reason = F.when(ready, L("")).otherwise(L(REASON_ALL if mode != "hybrid" else REASON_NONE))
    extra = [n for n in REPORT if n in features.columns]
    out = df.select(
        *IDS,
        L(version).alias("version"),
        L(mode).alias("mode"),
        score.alias("score"),
        "raw_score",
        "coverage_ratio",
        "active_component_count",
        active.alias("active_components"),
        missing.alias("missing_components"),
        L(NOTES[version]).alias("formula_note"),
        reason.alias("insufficient_reason"),
        *[x for n in cfg.COMPONENTS for x in (n, f"prov_{n}", f"source_{n}", f"contrib_{n}")],
        *[col.alias(name) for name, col in sens.items()],
        *extra,
    )
    return fx.fence(out.select(*columns) if columns else out)


def evaluate_all(features: DataFrame, mode: str, versions=cfg.VERSIONS, *, sensitivities: bool = True, columns=None) -> DataFrame:
    """All versions stacked. Each branch reads only the feature columns its version needs."""
    parts = [evaluate(features, v, mode, sensitivities=sensitivities, columns=columns) for v in versions]
    return reduce(DataFrame.unionByName, parts)


def top_contributors(results: DataFrame, k: int = 3) -> DataFrame:
    """Explanation: the k largest contributions by absolute value, ties in component order."""
    pairs = F.array(*[
        F.struct(F.abs(F.col(f"contrib_{n}")).alias("size"), L(-i).alias("place"), L(n).alias("name"))
        for i, n in enumerate(cfg.COMPONENTS)
    ])
    ranked = F.sort_array(F.filter(pairs, lambda x: x["size"].isNotNull()), asc=False)
    return results.withColumn("top_contributors", F.transform(F.slice(ranked, 1, k), lambda x: x["name"]))


def component_provenance(results: DataFrame) -> DataFrame:
    """Counts of direct / proxy / unavailable per version and component."""
    parts = F.array(*[F.struct(L(n).alias("component"), F.col(f"prov_{n}").alias("prov")) for n in cfg.COMPONENTS])
    long = results.select("version", F.inline(parts))
    kinds = ("direct", "proxy", "unavailable")
    return long.groupBy("version", "component").agg(*[F.count(F.when(F.col("prov") == k, 1)).alias(k) for k in kinds])


def best_examples(results: DataFrame) -> DataFrame:
    """Per version the row with the highest (coverage, active components, score)."""
    key = F.struct("coverage_ratio", "active_component_count", "score", "segment_id")
    return results.groupBy("version").agg(F.max_by(F.struct(*[F.col(x) for x in results.columns if x != "version"]), key).alias("row")).select("version", "row.*")
