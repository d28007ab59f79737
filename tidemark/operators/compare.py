"""Comparison of index versions per (dataset, mode, version)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.operators.ordered import exact_quantiles

L = F.lit
KEYS = ["dataset", "mode", "version"]


def label_stats(results: DataFrame, keys: list[str] = KEYS, value: str = "score") -> DataFrame:
    """Count, mean and sample variance of the value per label."""
    return results.groupBy(*keys, "label").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))


def pooled_d(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    """Cohen's d with pooled sample variance; NULL below two rows a side or without spread."""
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / F.nullif(n1 + n2 - L(2), L(0)))
    return F.when((n1 >= 2) & (n2 >= 2) & (pooled > 0), F.try_divide(m1 - m2, pooled))


def guarded_corr(x: str, y: str) -> Column:
    """Pearson correlation with at least 3 pairs and two distinct values on both sides."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    px, py = F.when(both, F.col(x)), F.when(both, F.col(y))
    varied = (F.min(px) < F.max(px)) & (F.min(py) < F.max(py))
    return F.when((F.count(px) >= 3) & varied, F.corr(px, py))


def histogram_overlap(
    rows: DataFrame, keys: list[str], side: Column, value: str, bins: int, *, constant: float | None
) -> DataFrame:
    """Share of overlap of two samples (side = 'a' / 'b') on a joint equal-width histogram.

    ``constant`` is the result when every value is equal (1.0 or NULL depending on the use).
    """
    data = rows.select(*keys, side.alias("_side"), F.col(value).alias("_v")).where(
        F.col("_side").isNotNull() & F.col("_v").isNotNull())
    extent = data.groupBy(*keys).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
        F.count(F.when(F.col("_side") == "a", 1)).alias("_na"), F.count(F.when(F.col("_side") == "b", 1)).alias("_nb"))
    cell = F.least(F.floor(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * L(bins)), L(bins - 1))
    counts = (
        data.join(extent, keys)
        .groupBy(*keys, "_na", "_nb", "_lo", "_hi", F.coalesce(cell, L(0)).alias("_bin"))
        .agg(F.count(F.when(F.col("_side") == "a", 1)).alias("_ca"), F.count(F.when(F.col("_side") == "b", 1)).alias("_cb"))
    )
    share = F.least(F.try_divide(F.col("_ca"), F.col("_na")), F.try_divide(F.col("_cb"), F.col("_nb")))
    flat = L(constant).cast("double")
    return counts.groupBy(*keys, "_na", "_nb", "_lo", "_hi").agg(F.sum(share).alias("_share")).select(
        *keys,
        F.when((F.col("_na") >= 2) & (F.col("_nb") >= 2), F.when(F.col("_lo") == F.col("_hi"), flat).otherwise(F.col("_share"))).alias("distribution_overlap"),
    )


def version_metrics(results: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """All quality metrics of a version. One wide aggregate plus two narrow ones on the same keys."""
    def of(label: str) -> Column:
        return F.when(F.col("label") == label, F.col("score"))

    aggs = [
        F.count(L(1)).alias("_rows"), F.count("score").alias("valid_segments"), F.avg("score").alias("mean_score"),
        F.stddev_samp("score").alias("std_score"),
        *[f(of(lab)).alias(f"_{n}_{lab}") for lab in ("stress", "baseline")
          for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))],
        guarded_corr("score", "arousal").alias("arousal_correlation"),
        guarded_corr("Q", "valence").alias("valence_correlation"),
        *[F.avg((F.col(f"prov_{c}") == "direct").cast("double")).alias(f"_direct_{c}") for c in cfg.COMPONENTS],
        *[F.avg(f"contrib_{c}").alias(f"mean_contrib_{c}") for c in cfg.COMPONENTS],
        *[F.avg(f"sens_{c}").alias(f"mean_sens_{c}") for c in cfg.SENSITIVITY_COMPONENTS],
    ]
    wide = results.groupBy(*keys).agg(*aggs)
    within = label_stats(results, keys).groupBy(*keys).agg(F.avg("variance").alias("within_group_variance"))
    side = F.when(F.col("label") == "stress", "a").when(F.col("label") == "baseline", "b")
    overlap = histogram_overlap(results, keys, side, "score", cfg.HISTOGRAM_BINS, constant=1.0)
    sens = F.array_compact(F.array(*[F.abs(F.col(f"mean_sens_{c}")) for c in cfg.SENSITIVITY_COMPONENTS]))
    df = wide.join(within, keys, "left").join(overlap, keys, "left")
    return df.select(
        *keys, "valid_segments", (F.col("valid_segments") / F.col("_rows")).alias("coverage"), "mean_score", "std_score",
        "within_group_variance",
        (F.col("_m_stress") - F.col("_m_baseline")).alias("stress_baseline_diff"),
        pooled_d(*[F.col(f"_{n}_stress") for n in "nmv"], *[F.col(f"_{n}_baseline") for n in "nmv"]).alias("effect_size"),
        "distribution_overlap", "arousal_correlation", "valence_correlation",
        F.when(F.size(sens) > 0, F.aggregate(sens, L(0.0), lambda a, x: a + x) / F.size(sens)).alias("relative_sensitivity"),
        (sum([F.col(f"_direct_{c}") for c in cfg.COMPONENTS], L(0.0)) / L(float(len(cfg.COMPONENTS)))).alias("direct_ratio"),
        *[f"mean_contrib_{c}" for c in cfg.COMPONENTS], *[f"mean_sens_{c}" for c in cfg.SENSITIVITY_COMPONENTS],
    )


def minmax(x: Column, over, *, missing: float | None = None) -> Column:
    """Min-max inside a window: a constant series is 1 for every row.

    missing=None keeps NULL for missing values and when nothing is defined; missing=0.0 is the
    clustering variant, where they count as 0.
    """
    lo, hi = F.min(x).over(over), F.max(x).over(over)
    scaled = F.try_divide(x - lo, hi - lo)
    if missing is None:
        return F.when(lo == hi, L(1.0)).otherwise(scaled)
    return F.when(lo == hi, L(1.0)).otherwise(F.coalesce(scaled, L(missing)))


def utility(metrics: DataFrame, within: tuple[str, ...] = ("dataset", "mode")) -> DataFrame:
    """Utility score, dense rank, over-smoothing flag and reliability level."""
    w = Window.partitionBy(*within)
    parts = {
        "effect_size": minmax(F.abs(F.col("effect_size")), w),
        "inverse_overlap": L(1.0) - minmax(F.col("distribution_overlap"), w),
        "relative_sensitivity": minmax(F.col("relative_sensitivity"), w),
        "arousal_correlation": minmax(F.abs(F.col("arousal_correlation")), w),
        "valence_correlation": minmax(F.abs(F.col("valence_correlation")), w),
        "stability": L(1.0) - minmax(F.col("within_group_variance"), w),
        "coverage": minmax(F.col("coverage"), w),
    }
    score = sum([L(cfg.UTILITY_WEIGHTS[k]) * F.coalesce(c, L(0.0)) for k, c in parts.items()], L(0.0))
    smooth = (F.col("distribution_overlap") > 0.65) & (F.abs(F.col("effect_size")) < 0.35) & (F.col("relative_sensitivity") < 0.08)
    enough = F.col("valid_segments") >= cfg.RELIABILITY["min_valid"]
    level = (
        F.when(enough & (F.col("direct_ratio") >= cfg.RELIABILITY["high"]), "high")
        .when(enough & (F.col("direct_ratio") >= cfg.RELIABILITY["medium"]), "medium")
        .otherwise("low")
    )
    df = metrics.withColumn("utility_score", score)
    return df.withColumns({
        "utility_rank": F.dense_rank().over(w.orderBy(F.desc("utility_score"))),
        "oversmoothing_flag": F.coalesce(smooth, L(False)),
        "reliability_level": level,
    })


def compare(results: DataFrame) -> DataFrame:
    return utility(version_metrics(results))


def rankings(compared: DataFrame) -> DataFrame:
    """Ordered version list, reliable versions and over-smoothing warnings per (dataset, mode)."""
    place = F.struct(F.col("utility_rank"), F.col("version"))
    pick = lambda arr: F.transform(F.array_sort(arr), lambda x: x["version"])
    keep = lambda cond: F.collect_list(F.when(cond, place))
    return compared.groupBy("dataset", "mode").agg(
        pick(F.collect_list(place)).alias("version_ranking"),
        pick(keep(F.col("reliability_level").isin("high", "medium"))).alias("reliable_comparisons"),
        pick(keep(F.col("oversmoothing_flag"))).alias("limitations"),
    )


def feature_availability(features: DataFrame, columns=cfg.FEATURES, keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Non-missing count and share (4 digits) per feature in one pass."""
    names = [c for c in columns if c in features.columns]
    wide = features.groupBy(*keys).agg(F.count(L(1)).alias("_rows"), *[F.count(c).alias(c) for c in names])
    long = wide.unpivot([*keys, "_rows"], names, "feature", "valid_segments")
    return long.select(*keys, "feature", "valid_segments", F.round(F.col("valid_segments") / F.col("_rows"), 4).alias("share"))


def box_quantiles(results: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Box plot data: exact quartiles and extremes of the score per label."""
    groups = [*keys, "label"]
    q = exact_quantiles(results, groups, "score", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    ends = results.groupBy(*groups).agg(F.count("score").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
    return ends.where(F.col("n") > 0).join(q, groups)


def scatter_pairs(results: DataFrame, x: str, y: str, keys: list[str] = KEYS) -> DataFrame:
    return results.select(*keys, "segment_id", "label", F.col(x).alias("x"), F.col(y).alias("y")).dropna(subset=["x", "y"])


#: Points of a scatter plot.
SCATTER_POINTS = 2500


def scatter_sample(points: DataFrame, groups: list[str], point: str = "segment_id", limit: int = SCATTER_POINTS, seed: int = 42) -> DataFrame:
    """At most ``limit`` points of each group: those of the smallest md5 of seed and id, whatever the partitioning.

    Ties are ordered by all other columns, NULL ids by the digest of the empty id; NULL groups are groups. Every task keeps
    its own ``limit`` least before the shuffle (the planner's group limit), so no group arrives whole in one task.
    """
    mark = F.md5(F.concat(L(f"{seed}:"), F.coalesce(F.col(point).cast("string"), L(""))))
    rest = [c for c in points.columns if c not in groups]
    order = Window.partitionBy(*groups).orderBy("_mark", *rest)
    return points.withColumn("_mark", mark).withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= limit).drop("_mark", "_place")
