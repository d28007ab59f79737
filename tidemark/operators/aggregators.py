"""Window-array aggregators and their evaluation against a target and state labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.functions import columns as fx
from tidemark.operators.compare import pooled_d
from tidemark.operators.ordered import average_ranks, exact_quantiles, with_single_row
from tidemark.operators.separation import epsilon_squared, kruskal

L = F.lit
METHODS = (
    "linear_mean", "sigmoid_mean", "tanh_mean", "softsign_mean", "arctan_mean",
    "softmax_weighted_sum", "structural", "structural_attentive",
)
# Blend weights of level, spread, energy; attention gains and temperature.
BLEND = (0.35, 0.30, 0.35)
ATTENTIVE_BLEND = (0.32, 0.28, 0.40)
ATTENTION = (0.60, 0.40)
TEMPERATURE = 1.0
# End of fixed values.


def window_statistics(windows: DataFrame, column: str = "window_values") -> DataFrame:
    """Mean, population std, log energy and rms of every window, each from one fold over the array."""
    sums = F.aggregate(
        column, F.struct(L(0.0).alias("s"), L(0.0).alias("q")),
        lambda acc, x: F.struct((acc["s"] + x).alias("s"), (acc["q"] + x * x).alias("q")))
    df = windows.withColumns({"_sums": sums, "_n": F.size(column)})
    df = df.withColumns({"w_mean": F.col("_sums.s") / F.col("_n"), "w_square": F.col("_sums.q") / F.col("_n")})
    spread = F.aggregate(column, L(0.0), lambda acc, x: acc + (x - F.col("w_mean")) * (x - F.col("w_mean")))
    return df.withColumns({
        "w_std": F.sqrt(spread / F.col("_n")), "w_energy": F.log1p(F.col("w_square")), "target_rms": F.sqrt(F.col("w_square")),
    }).drop("_sums")


def global_moments(stats: DataFrame) -> DataFrame:
    """Mean and population std over all samples of all windows, merged from the window sums."""
    n = F.sum("_n")
    mean = F.sum(F.col("w_mean") * F.col("_n")) / n
    # sum of squared deviations inside windows plus between windows
    agg = stats.agg(n.alias("_gn"), mean.alias("g_mean"), F.sum(F.col("w_std") * F.col("w_std") * F.col("_n")).alias("_in"),
                    (F.var_pop("w_mean")).alias("_between"))
    return agg.select("g_mean", F.greatest(F.sqrt(F.col("_in") / F.col("_gn") + F.col("_between")), L(cfg.EPSILON)).alias("g_std"))


def _z_over_all(df: DataFrame, names: list[str]) -> DataFrame:
    """Population z-scores of columns over the whole table (one-row aggregate, no global window)."""
    moments = df.agg(*[f(n).alias(f"{n}_{k}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = with_single_row(df, moments)
    return out.withColumns({
        f"z_{n}": (F.col(n) - F.col(f"{n}_m")) / F.greatest(F.col(f"{n}_s"), L(cfg.EPSILON)) for n in names
    }).drop(*[f"{n}_{k}" for n in names for k in "ms"])


def _mean_of(array: Column, f) -> Column:
    return F.aggregate(array, L(0.0), lambda acc, x: acc + f(x)) / F.size(array)


def method_values(windows: DataFrame, column: str = "window_values") -> DataFrame:
    """One column per aggregation method plus the target rms."""
    stats = window_statistics(windows, column)
    df = with_single_row(stats, global_moments(stats))
    df = df.withColumn("_z", F.transform(column, lambda x: (x - F.col("g_mean")) / F.col("g_std")))
    df = df.withColumn("_top", F.array_max("_z") / L(TEMPERATURE))
    soft = F.aggregate("_z", F.struct(L(0.0).alias("w"), L(0.0).alias("v")), lambda acc, x: F.struct(
        (acc["w"] + F.exp(x / L(TEMPERATURE) - F.col("_top"))).alias("w"), (acc["v"] + x * F.exp(x / L(TEMPERATURE) - F.col("_top"))).alias("v")))
    local = lambda x: (x - F.col("w_mean")) / F.greatest(F.col("w_std"), L(cfg.EPSILON))
    drive = F.transform(column, lambda x: L(ATTENTION[0]) * local(x) + L(ATTENTION[1]) * F.abs(local(x)))
    df = df.withColumns({
        "linear_mean": _mean_of(F.col("_z"), lambda x: x),
        "sigmoid_mean": _mean_of(F.col("_z"), fx.sigmoid),
        "tanh_mean": _mean_of(F.col("_z"), F.tanh),
        "softsign_mean": _mean_of(F.col("_z"), lambda x: x / (L(1.0) + F.abs(x))),
        "arctan_mean": _mean_of(F.col("_z"), lambda x: L(2.0 / math.pi) * F.atan(x)),
        "_soft": soft,
        "_drive": drive,
    })
    df = df.withColumns({"softmax_weighted_sum": F.col("_soft.v") / F.col("_soft.w"), "_peak": F.array_max("_drive")})
    df = df.withColumn("_pairs", F.zip_with("_drive", column, lambda d, x: F.struct(F.exp((d - F.col("_peak")) / L(TEMPERATURE)).alias("w"), x.alias("x"))))
    moments = F.aggregate("_pairs", F.struct(L(0.0).alias("w"), L(0.0).alias("m"), L(0.0).alias("q")), lambda acc, p: F.struct(
        (acc["w"] + p["w"]).alias("w"), (acc["m"] + p["w"] * p["x"]).alias("m"), (acc["q"] + p["w"] * p["x"] * p["x"]).alias("q")))
    df = df.withColumn("_mom", moments)
    df = df.withColumn("a_mean", F.col("_mom.m") / F.col("_mom.w"))
    around = F.aggregate("_pairs", L(0.0), lambda acc, p: acc + p["w"] * (p["x"] - F.col("a_mean")) * (p["x"] - F.col("a_mean")))
    df = df.withColumns({"a_std": F.sqrt(around / F.col("_mom.w")), "a_energy": F.log1p(F.col("_mom.q") / F.col("_mom.w"))})
    keep = [c for c in windows.columns if c != column]
    df = fx.fence(df.select(*keep, "target_rms", *METHODS[:6], "w_mean", "w_std", "w_energy", "a_mean", "a_std", "a_energy"))
    df = _z_over_all(df, ["w_mean", "w_std", "w_energy", "a_mean", "a_std", "a_energy"])
    blend = lambda w, p: L(w[0]) * F.col(f"z_{p}_mean") + L(w[1]) * F.col(f"z_{p}_std") + L(w[2]) * F.col(f"z_{p}_energy")
    return df.select(*keep, "target_rms", *METHODS[:6], blend(BLEND, "w").alias("structural"), blend(ATTENTIVE_BLEND, "a").alias("structural_attentive"))


def method_rows(values: DataFrame, keep=("scenario", "state", "sample_index", "target_rms")) -> DataFrame:
    """Long table: one row per window and method."""
    return values.unpivot(list(keep), list(METHODS), "method", "value")


def method_metrics(long: DataFrame, keys=("scenario", "method")) -> DataFrame:
    """Pearson, Spearman, p95-p05, epsilon squared and mean absolute pairwise d per method."""
    k = list(keys)
    base = long.groupBy(*k).agg(F.corr("value", "target_rms").alias("pearson_target_corr"))
    q = exact_quantiles(long, k, "value", {"lo": 0.05, "hi": 0.95}).select(*k, (F.col("hi") - F.col("lo")).alias("dynamic_range_p95_p05"))
    rank = lambda col, out: average_ranks(long, k, ["sample_index"], col).select(*k, "sample_index", F.col("rank").alias(out))
    spear = rank("value", "ra").join(rank("target_rms", "rb"), [*k, "sample_index"]).groupBy(*k).agg(F.corr("ra", "rb").alias("spearman_target_corr"))
    eps = epsilon_squared(kruskal(long, k, "state", "value")).select(*k, "epsilon_squared")
    stats = long.groupBy(*k, "state").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    a, b = (stats.select(*k, *[F.col(c).alias(f"{c}{s}") for c in ("state", "n", "m", "v")]) for s in "ab")
    d = pooled_d(*[F.col(f"{c}a") for c in "nmv"], *[F.col(f"{c}b") for c in "nmv"])
    pairs = a.join(b, k).where(F.col("statea") < F.col("stateb")).groupBy(*k).agg(F.avg(F.abs(d)).alias("avg_pairwise_d"))
    return base.join(spear, k).join(q, k).join(eps, k).join(pairs, k)


def scaled_for_plot(long: DataFrame, keys=("scenario", "method")) -> DataFrame:
    """Value scaled to 0..1 between its 5th and 95th percentile; 0.5 when flat."""
    q = exact_quantiles(long, list(keys), "value", {"lo": 0.05, "hi": 0.95})
    span = F.col("hi") - F.col("lo")
    scaled = F.when(span <= cfg.EPSILON, L(0.5)).otherwise(fx.clip(F.try_divide(F.col("value") - F.col("lo"), span)))
    return long.join(q, list(keys)).withColumn("plot_value", scaled).drop("lo", "hi")


def target_bins(scaled: DataFrame, bins: int = 12) -> DataFrame:
    """Mean target and output per equal-frequency bin of the target (quantile edges, right-closed)."""
    names = {f"e{i}": i / bins for i in range(bins + 1)}
    edges = exact_quantiles(scaled, [], "target_rms", names)
    df = with_single_row(scaled, edges)
    index = sum([(F.col("target_rms") > F.col(f"e{i}")).cast("int") for i in range(1, bins)], L(0))
    df = df.withColumn("target_bin", index)
    return df.groupBy("scenario", "method", "target_bin").agg(F.avg("target_rms").alias("target_rms"), F.avg("plot_value").alias("output"))


