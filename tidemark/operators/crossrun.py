"""Tables across runs: version matrix, best versions, scenario rows, confirmations, drill-down."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.functions import columns as fx

L = F.lit
KEYS = ["dataset", "mode", "version"]
# Scenario lists of the reports.
SCENARIOS = (
    ("case", "hybrid"), ("wesad", "hybrid"), ("ds002722", "strict"), ("ds002722", "proxy"),
    ("ds002724", "strict"), ("ds002724", "proxy"), ("dreamer", "strict"),
)
DYNAMIC_SCENARIOS = (("ds002722", "strict"), ("ds002724", "strict"), ("dreamer", "strict"))
# End of fixed values.


def reliability_order(level: Column) -> Column:
    return fx.by_key(level, {"high": 0, "medium": 1, "low": 2}, L(3))


def detailed_matrix(comparison: DataFrame, capacity: DataFrame) -> DataFrame:
    """Comparison left-joined to state capacity with effect, inverse overlap and a separation value."""
    df = comparison.join(capacity, KEYS, "left")
    df = df.withColumns({"effect_abs": F.abs("effect_size"), "inverse_overlap": L(1.0) - F.col("distribution_overlap")})
    return df.withColumns({
        "separation_proxy": L(0.6) * F.col("effect_abs") + L(0.4) * F.col("inverse_overlap"),
        "is_usable": (F.coalesce("coverage", L(0.0)) > 0) & (F.coalesce("valid_segments", L(0)) > 0),
    })


_ORDER = ("reliability_order", "utility_rank", "utility_score", "effect_abs", "inverse_overlap")


def best_versions(matrix: DataFrame, by: tuple[str, ...] = ("dataset", "mode"), *, mix_columns: bool = False) -> DataFrame:
    """Best usable row per scenario. mix_columns takes the first non-null value of every column
    separately, which may combine rows; the default returns one real row."""
    df = matrix.where("is_usable").withColumn("reliability_order", reliability_order(F.col("reliability_level")))
    order = [F.asc_nulls_last("reliability_order"), F.asc_nulls_last("utility_rank"), F.desc_nulls_last("utility_score"),
             F.desc_nulls_last("effect_abs"), F.desc_nulls_last("inverse_overlap"), F.asc("version")]
    w = Window.partitionBy(*by).orderBy(*order)
    if not mix_columns:
        return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "reliability_order")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    others = [c for c in matrix.columns if c not in by]
    firsts = df.select(*by, *[F.first(c, ignorenulls=True).over(full).alias(c) for c in others], F.row_number().over(w).alias("_rn"))
    return firsts.where("_rn = 1").drop("_rn")


def version_rows(spark: SparkSession) -> DataFrame:
    """Compatibility table of the versions (fixed small dimension)."""
    rows = [(v, v in cfg.RESOURCE_VERSIONS, v in ("V1", "V2", "V3")) for v in cfg.VERSIONS]
    df = spark.createDataFrame(rows, "version string, dynamic_supported boolean, needs_proxy boolean")
    return df.withColumns({"static_supported": L(True), "proxy_supported": L(True), "hybrid_supported": L(True)})


def scenario_rows(matrix: DataFrame, spark: SparkSession, dynamic: DataFrame, scenarios=SCENARIOS) -> DataFrame:
    """Scenario x version grid left-joined to the matrix, dynamic support and a status bucket."""
    grid = spark.createDataFrame([(d, m, v) for d, m in scenarios for v in cfg.VERSIONS], "dataset string, mode string, version string")
    df = grid.join(matrix, KEYS, "left").join(dynamic.select(*KEYS, L(True).alias("_dyn")).distinct(), KEYS, "left")
    needed = F.concat_ws("/", "dataset", "mode").isin(*[f"{d}/{m}" for d, m in DYNAMIC_SCENARIOS])
    df = df.withColumn("availability_status", F.when(F.coalesce("coverage", L(0.0)) > 0, "available").otherwise("not_available"))
    return df.withColumns({
        "dynamic_state": F.when(F.col("version").isin("V1", "V2", "V3"), "not_adapted").when(F.col("_dyn"), "available")
        .when(needed, "missing_required").otherwise("partial_optional"),
        "status": status_bucket(),
    }).drop("_dyn")


def status_bucket() -> Column:
    good = (F.col("reliability_level") == "high") & (F.col("coverage") > 0) & ~F.coalesce("oversmoothing_flag", L(False))
    return (
        F.when(F.col("availability_status") == "not_available", "danger").when(good, "success")
        .when(F.col("version").isin("V1", "V2", "V3"), "danger").otherwise("warning")
    )


def state_confirmation(rows: DataFrame) -> DataFrame:
    """Top row per scenario by utility + .05 confident + .02 likely; a placeholder when nothing is usable."""
    scenarios = rows.select("dataset", "mode").distinct()
    z = lambda n: F.coalesce(F.col(n), L(0))
    score = z("utility_score") + L(0.05) * z("confident_state_count") + L(0.02) * z("likely_state_count")
    usable = rows.where(F.coalesce("coverage", L(0.0)) > 0).withColumn("confirmation_score", score)
    w = Window.partitionBy("dataset", "mode").orderBy(F.desc("confirmation_score"), F.asc_nulls_last("utility_rank"), "version")
    best = usable.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    out = scenarios.join(best.select("dataset", "mode", "version", "confirmation_score", "capacity_verdict", "consensus_supported_k"), ["dataset", "mode"], "left")
    return out.select(
        "dataset", "mode", F.coalesce("version", L("-")).alias("best_version"), "confirmation_score",
        F.when(F.col("version").isNull(), "not available").otherwise(F.coalesce("capacity_verdict", L("-"))).alias("confirmed_states"),
        F.when(F.col("version").isNull(), "-").otherwise(F.concat(L("k="), F.coalesce(F.col("consensus_supported_k").cast("string"), L("-")))).alias("possible_ceiling"))


def strongest_strict(matrix: DataFrame) -> DataFrame:
    """The strict row with the largest effect; reliability breaks ties alphabetically (a top-1 report)."""
    df = matrix.where((F.col("mode") == "strict") & (F.coalesce("coverage", L(0.0)) > 0))
    return df.orderBy(F.desc_nulls_last("effect_abs"), F.desc_nulls_last("utility_score"), F.asc_nulls_last("reliability_level"), "dataset", "version").limit(1)


def one_decimal(value: Column) -> Column:
    """Text with one decimal, rounded on the exact binary value and ties to even, as printf does.

    ``format_string`` rounds the shortest decimal form half up: 12.25 and 0.15 (a double below it) would go up. The
    fraction of a double is a double itself, so it is compared exactly with the double next to each border.
    """
    size = F.abs(value)
    part = size - F.floor(size)
    borders = []
    for k in range(10):
        near, exact = (2 * k + 1) / 20, Fraction(2 * k + 1, 20)
        up = Fraction(near) > exact or Fraction(near) == exact and k % 2 == 1
        borders.append((part >= L(near) if up else part > L(near)).cast("long"))
    tenths = F.floor(size) * L(10) + sum(borders[1:], borders[0])
    sign = F.when((value < 0) | (value.cast("string") == "-0.0"), "-").otherwise("")
    text = F.concat(sign, (tenths / L(10)).cast("long").cast("string"), L("."), (tenths % L(10)).cast("string"))
    return F.when(size < L(1e15), text).otherwise(F.format_string("%.1f", value))


def drill_down(features: DataFrame) -> DataFrame:
    """Feature list of each segment with provenance and a readable key."""
    key = F.concat_ws(" | ", "dataset", "subject_id", "segment_id", one_decimal(F.col("window_start_sec")))
    cells = F.array(*[
        F.struct(L(n).alias("feature"), F.col(n).alias("value"), F.col(f"prov_{n}").alias("provenance"), F.col(f"source_{n}").alias("source"))
        for n in (*cfg.EEG_FEATURES, *cfg.CARDIAC_FEATURES, "stress_label")])
    return features.select("segment_id", key.alias("segment_key"), F.inline(cells))
