"""Parameter search with subject-held-out folds: every candidate on every fold in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.functions import columns as fx
from tidemark.functions.structural import Spec, staged
from tidemark.operators import indices as ix
from tidemark.operators.compare import pooled_d
from tidemark.operators.ordered import exact_quantiles, null_safe_join, with_position
from tidemark.operators.separation import epsilon_squared, kruskal
from tidemark.plans.staging import stage

L = F.lit
TRANSFORMS = ("alpha_asymmetry", "total_asymmetry", "gamma_log", "gamma_alpha_log", "heart_rate", "hf_lf_log")
LABELS = ("baseline", "disbalance", "stress")

# Uniform ranges of the searched parameters.
V5_RANGES = {
    "weight_A": (0.08, 0.20), "weight_Gamma": (0.03, 0.15), "weight_V": (0.14, 0.34), "weight_Q": (0.40, 0.75),
    "q_linear_gain": (0.8, 2.2), "q_coherence_gain": (0.15, 1.00), "q_mismatch_penalty": (0.15, 0.90),
    "q_gamma_penalty": (0.05, 0.40), "q_signed_power": (0.65, 1.00), "q_synergy_gain": (0.00, 0.80),
    "q_energy_gain": (0.00, 0.60), "q_conflict_gain": (0.00, 0.60), "q_gamma_v_penalty": (0.00, 0.40),
    "output_center": (-0.20, 0.20), "output_gain": (1.40, 4.00), "output_curve": (0.00, 1.40),
    "output_balance_coupling": (0.00, 0.40), "output_gamma_brake": (0.00, 0.20), "output_contrast_mix": (0.15, 0.55),
    "output_signed_power": (0.70, 1.00), "output_regime_gain": (0.00, 0.90), "output_energy_gain": (0.00, 0.70),
    "output_conflict_gain": (0.00, 0.50), "output_gamma_cross_penalty": (0.00, 0.25),
}
V7_RANGES = {
    "weight_A": (0.10, 0.22), "weight_Gamma": (0.04, 0.12), "weight_V": (0.14, 0.32), "weight_Q": (0.38, 0.72),
    "temperature": (0.90, 3.20), "structure_weight": (0.10, 0.90), "energy_weight": (0.05, 0.60),
    "component_gain": (0.85, 1.80), "q_gain": (0.90, 3.00), "q_coherence_penalty": (0.20, 0.90),
    "q_gamma_penalty": (0.05, 0.35), "gate_temperature": (0.90, 2.60), "reg_score_base": (0.72, 0.90),
    "reg_score_amp": (0.08, 0.22), "mob_score_base": (0.42, 0.62), "mob_score_amp": (0.06, 0.18), "dep_score_base": (0.10, 0.30),
    "dep_score_amp": (0.08, 0.22), "transition_entropy_weight": (0.02, 0.16), "regime_balance_weight": (0.00, 0.12),
    "conflict_penalty": (0.04, 0.18),
}
# End of fixed values.
RANGES = {"V5": V5_RANGES, "V7": V7_RANGES}


def random_candidates(spark: SparkSession, version: str, trials: int, seed: int = 42) -> DataFrame:
    """Uniform candidates; the stream of numbers is Spark's, so only its properties can be checked."""
    cols = [(L(lo) + L(hi - lo) * F.rand(seed + i)).alias(n) for i, (n, (lo, hi)) in enumerate(RANGES[version].items())]
    return spark.range(0, trials, 1, 1).select(F.col("id").alias("trial_index"), *cols)


def build_params(candidates: DataFrame, version: str) -> DataFrame:
    """Candidate values over the defaults; weights floored at 1e-6 and normalised."""
    defaults = cfg.V5 if version == "V5" else cfg.V7
    weights = cfg.WEIGHTS[version]
    floor = {n: F.greatest(F.coalesce(F.col(f"weight_{n}") if f"weight_{n}" in candidates.columns else L(None), L(w)), L(1e-6)) for n, w in weights.items()}
    searched = any(f"weight_{n}" in candidates.columns for n in weights)
    mass = fx.total(list(floor.values())) if searched else L(1.0)
    cols = [(floor[n] / mass if searched else L(w)).alias(f"w_{n}") for n, w in weights.items()]
    cols += [(F.col(k) if k in candidates.columns else L(float(v))).alias(f"p_{k}") for k, v in defaults.items()]
    return candidates.select("trial_index", *cols)


def subject_folds(rows: DataFrame, folds: int) -> DataFrame:
    """Round-robin fold per subject in id order (at least two folds).

    A range partitioning of the ids gives the buckets; it is staged, as its borders come from a sample.
    """
    dealt = rows.select("subject_id").distinct().repartitionByRange("subject_id").withColumns({"_part": F.spark_partition_id(), "_all": L(0)})
    ranked = with_position(stage(dealt, "subjects"), ["_all"], ["subject_id"], F.col("_part"), "place").drop("_part")
    return ranked.select("subject_id", (F.col("place") % max(folds, 2)).alias("fold"))


def transforms(rows: DataFrame, epsilon: float = cfg.SEARCH_EPSILON) -> DataFrame:
    """The six calibrated quantities (x_ columns)."""
    c = F.col
    return rows.withColumns({
        "x_alpha_asymmetry": c("alpha_asymmetry"),
        "x_total_asymmetry": fx.asymmetry(c("eeg_left_power"), c("eeg_right_power"), epsilon),
        "x_gamma_log": fx.gamma_log(c("eeg_gamma_power")),
        "x_gamma_alpha_log": fx.ratio_log(c("gamma_alpha_ratio")),
        "x_heart_rate": c("heart_rate"),
        "x_hf_lf_log": fx.ratio_log(c("hrv_hf_lf")),
    })


def base_calibration(rows: DataFrame, groups: list[str], left_out: tuple[str, list] | None = None) -> DataFrame:
    """Robust centre and width of every transform: median and half the 5-95 % span, one row per group.

    ``left_out`` as in ``exact_quantiles``: one row per group and value, without the rows of the value.
    """
    groups = [*groups, left_out[0]] if left_out else groups
    cells = F.array(*[F.struct(L(t).alias("t"), F.col(f"x_{t}").alias("x")) for t in TRANSFORMS])
    by = [g for g in groups if not left_out or g != left_out[0]]
    q = exact_quantiles(rows.select(*groups, F.inline(cells)), [*by, "t"], "x", {"lo": 0.05, "mid": 0.5, "hi": 0.95}, left_out=left_out)
    width = F.greatest((F.col("hi") - F.col("lo")) / L(2.0), L(1e-6))
    pick = lambda t, col: F.max(F.when(F.col("t") == t, col))
    aggs = [x for t in TRANSFORMS for x in (pick(t, F.col("mid")).alias(f"c_{t}"), pick(t, width).alias(f"s_{t}"))]
    return q.groupBy(*groups).agg(*aggs) if groups else q.agg(*aggs)


def training_base(rows: DataFrame, folds: int) -> DataFrame:
    """Base calibration per fold from the rows of all other folds."""
    if folds < 2:
        return base_calibration(rows.drop("fold").withColumn("fold", F.lit(0)), ["fold"])
    return base_calibration(rows, [], ("fold", list(range(folds))))


def _terms(df: DataFrame) -> DataFrame:
    t = lambda n: F.tanh((F.col(f"x_{n}") - F.col(f"c_{n}")) / F.col(f"s_{n}"))
    return df.withColumns({
        "t_alpha": t("alpha_asymmetry"), "t_total": t("total_asymmetry"), "t_gamma": t("gamma_log"), "t_burden": t("gamma_alpha_log"),
        "t_hr": F.tanh((F.col("c_heart_rate") - F.col("x_heart_rate")) / F.col("s_heart_rate")), "t_hrv": t("hf_lf_log")})


def _param(name: str) -> Column:
    return F.col(f"p_{name}")


def score_v5(df: DataFrame) -> DataFrame:
    """V5 with base (c_, s_), parameter (p_) and weight (w_) columns; A and Gamma need both terms."""
    df = _terms(df)
    c = F.col
    df = df.withColumns({
        "A": F.tanh(L(1.10) * c("t_alpha") + L(0.40) * c("t_total")),
        "Gamma": F.tanh(L(0.30) * c("t_gamma") + L(0.70) * c("t_burden")),
        "V": F.coalesce(F.tanh(L(0.80) * c("t_hr") + L(0.20) * c("t_hrv")), c("t_hr"), c("t_hrv")),
    })
    z = lambda n: F.coalesce(c(n), L(0.0))
    params = {k: _param(k) for k in cfg.V5}
    df, q = ix.contrast_q(df, L(0.50) * z("A") + L(0.42) * z("V") - L(0.30) * z("Gamma"), params)
    df = df.withColumn("Q", q)
    core = c("w_A") * z("A") - c("w_Gamma") * z("Gamma") + c("w_V") * z("V") + c("w_Q") * z("Q")
    # pairs with a missing side add nothing here, unlike the live score where it enters as 0
    df = df.withColumn("core", core)
    return _search_contrast(df, params).withColumnRenamed("score_b", "score")


def _search_contrast(df: DataFrame, p: dict[str, Column]) -> DataFrame:
    c, zero = F.col, L(0.0)
    z = lambda x: F.coalesce(x, zero)
    df = df.withColumns({f"o_{n}": fx.signed_power(c(n), p["output_signed_power"]) for n in ("A", "V", "Q")})
    a, v, q = c("o_A"), c("o_V"), c("o_Q")
    df = df.withColumns({
        "o_ctr": L(0.14) * z(a) - L(0.08) * z(c("Gamma")) + L(0.22) * z(v) + L(0.56) * z(q) - p["output_center"],
        "o_syn": z(fx.signed_root(a, v)) + L(0.8) * z(fx.signed_root(q, v)),
        "o_nrg": F.sqrt((z(a) * z(a) + z(v) * z(v) + z(q) * z(q)) / L(3.0)),
        "o_cfl": z(F.abs(a - v)) + L(0.75) * z(F.abs(q - v)),
        "o_brk": F.greatest(z(c("Gamma")), zero),
    })
    ctr = c("o_ctr")
    drive = (
        p["output_gain"] * ctr + p["output_curve"] * ctr * ctr * ctr + p["output_balance_coupling"] * (z(c("Q")) - z(c("V")))
        - p["output_gamma_brake"] * c("o_brk") + p["output_regime_gain"] * c("o_syn") + p["output_energy_gain"] * c("o_nrg") * F.signum(ctr)
        - p["output_conflict_gain"] * c("o_cfl")
        - p["output_gamma_cross_penalty"] * c("o_brk") * (L(1.0) - F.greatest(z(c("V")), zero))
    )
    base = fx.sigmoid(c("core") + L(0.22) * c("o_syn") - L(0.10) * c("o_cfl"))
    mix = p["output_contrast_mix"]
    score = (L(1.0) - mix) * base + mix * (L(0.5) + L(0.5) * F.tanh(drive))
    return df.withColumn("score_b", F.least(F.greatest(score, zero), L(1.0)))


def score_v7(df: DataFrame) -> DataFrame:
    """V7 with base, parameter and weight columns; a missing component makes the score missing."""
    df = _terms(df)
    c = F.col
    params = {k: _param(k) for k in cfg.V7}
    df = df.withColumns({
        "k_a0": c("t_alpha"), "k_a1": L(0.55) * c("t_total"), "k_a2": L(0.35) * fx.signed_root(c("t_alpha"), c("t_total")),
        "k_g0": L(0.35) * c("t_gamma"), "k_g1": L(0.75) * c("t_burden"), "k_g2": L(0.20) * fx.signed_root(c("t_gamma"), c("t_burden")),
        "k_v0": L(0.85) * c("t_hr"), "k_v1": L(0.30) * c("t_hrv"), "k_v2": L(0.20) * fx.signed_root(c("t_hr"), c("t_hrv")),
    })
    df = staged(df, [Spec(f"r_{k}", tuple(f"k_{k}{i}" for i in range(3))) for k in "agv"], params, keep_single=False)
    df = df.withColumns({n: F.tanh(params["component_gain"] * c(f"r_{k}")) for n, k in (("A", "a"), ("Gamma", "g"), ("V", "v"))})
    a, g, v = c("A"), c("Gamma"), c("V")
    df = df.withColumns({
        "q0": L(0.52) * a + L(0.44) * v - L(0.32) * g,
        "q1": a * v - params["q_coherence_penalty"] * F.abs(a - v) - params["q_gamma_penalty"] * fx.positive(g)})
    df = df.withColumn("q2", L(0.55) * fx.signed_root(c("q0"), c("q1")))
    df = staged(df, [Spec("r_q", ("q0", "q1", "q2"))], params, keep_single=False)
    df = df.withColumn("Q", fx.clip(L(0.5) + L(0.5) * F.tanh(params["q_gain"] * c("r_q"))))
    df = ix.structural_regime_scores(df, {"b": {"a": "A", "g": "Gamma", "v": "V", "q": "Q"}}, params, keep_single=False)
    return df.withColumn("score", F.when(c("Q").isNotNull(), c("score_b"))).drop("score_b")


SCORERS = {"V5": score_v5, "V7": score_v7}


#: Columns of scored candidates, and those that the objective reads.
SCORED = ("trial_index", "fold", "label", "segment_id", "A", "Gamma", "V", "Q", "score")
JUDGED = ("trial_index", "fold", "label", "Gamma", "score")


def score_candidates(rows: DataFrame, params: DataFrame, version: str, trials: int, columns=SCORED) -> DataFrame:
    """Every row under every candidate 0..trials-1: an equi-join on the candidate, which the planner broadcasts if it is small."""
    keep = ["fold", "label", "subject_id", "segment_id", *[f"x_{t}" for t in TRANSFORMS], *[f"{k}_{t}" for k in "cs" for t in TRANSFORMS]]
    wide = rows.select(*keep, F.explode(F.sequence(L(0).cast("long"), L(trials - 1).cast("long"))).alias("trial_index"))
    scored = SCORERS[version](wide.join(params, "trial_index"))
    return fx.fence(scored.select(*columns))


def middle_state(b: Column, d: Column, s: Column) -> Column:
    """How well the middle label lies between the outer two: 1 at the midpoint, 0 outside."""
    low, high = F.least(b, s), F.greatest(b, s)
    inside = F.when((d >= low) & (d <= high), L(1.0)).otherwise(L(0.0))
    score = F.greatest(inside * (L(1.0) - F.try_divide(F.abs(d - L(0.5) * (b + s)), high - low)), L(0.0))
    return F.when(b.isNull() | d.isNull() | s.isNull() | (high - low <= 1e-9), L(0.0)).otherwise(score)


def objective(scored: DataFrame, groups: list[str]) -> DataFrame:
    """Search objective and its parts per group."""
    def of(label: str) -> Column:
        return F.when(F.col("label") == label, F.col("score"))

    agg = scored.groupBy(*groups).agg(
        *[f(of(lab)).alias(f"{n}_{lab}") for lab in LABELS for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))],
        F.stddev_samp("score").alias("std_score"), F.stddev_samp("Gamma").alias("gamma_std"))
    d = lambda a, b: F.abs(pooled_d(*[F.col(f"{k}_{a}") for k in "nmv"], *[F.col(f"{k}_{b}") for k in "nmv"]))
    pairs = F.array_compact(F.array(d("baseline", "disbalance"), d("baseline", "stress"), d("disbalance", "stress")))
    eps = epsilon_squared(kruskal(scored.where(F.col("label").isin(*LABELS)), groups, "label", "score"))
    df = agg.join(eps.select(*groups, "epsilon_squared"), groups, "left")
    df = df.withColumns({
        "avg_pairwise_d": F.try_divide(F.aggregate(pairs, L(0.0), lambda a, x: a + x), F.size(pairs)),
        "baseline_stress_d": d("baseline", "stress"),
        "middle_score": middle_state(F.col("m_baseline"), F.col("m_disbalance"), F.col("m_stress")),
    })
    z = lambda n: F.coalesce(F.col(n), L(0.0))
    total = z("avg_pairwise_d") + L(0.8) * z("baseline_stress_d") + L(1.5) * z("epsilon_squared") + L(0.3) * F.col("middle_score") + L(0.1) * z("std_score")
    return df.select(*groups, total.alias("objective"), "avg_pairwise_d", "baseline_stress_d", "epsilon_squared", "middle_score", "std_score", "gamma_std")


def across_folds(per_fold: DataFrame) -> DataFrame:
    """Mean and population std of the objective and means of its parts over the folds."""
    parts = ("avg_pairwise_d", "baseline_stress_d", "epsilon_squared", "middle_score", "std_score", "gamma_std")
    return per_fold.groupBy("trial_index").agg(
        F.avg("objective").alias("objective_mean"), F.stddev_pop("objective").alias("objective_std"), *[F.avg(p).alias(f"{p}_mean") for p in parts])


def evaluate_candidates(features: DataFrame, candidates: DataFrame, version: str, trials: int, *, folds: int = 4, base: str = "global", staging=None) -> DataFrame:
    """Whole search: base calibration (global: the fixed one; else fitted per training fold), all candidates, all folds.

    staging (a function DataFrame, name -> DataFrame) keeps the scored rows for the several aggregates.
    """
    rows = null_safe_join(transforms(features), subject_folds(features, folds), ["subject_id"])  # rows without a subject are one subject
    if base == "global":
        rows = rows.withColumns({f"{k}_{t}": L(float(x)) for t in TRANSFORMS for k, x in zip("cs", cfg.CALIBRATION[t])})
    else:
        rows = rows.join(training_base(rows, max(folds, 2)), "fold")
    scored = score_candidates(rows, build_params(candidates, version), version, trials, JUDGED)
    if staging is not None:
        scored = staging(scored, "candidates")
    return across_folds(objective(scored, ["trial_index", "fold"]))


def top_candidates(evaluated: DataFrame, k: int = 10) -> DataFrame:
    """Best candidates by objective, effect and pairwise distance (a top-k report)."""
    return evaluated.orderBy(F.desc("objective_mean"), F.desc("epsilon_squared_mean"), F.desc("avg_pairwise_d_mean"), "trial_index").limit(k)
