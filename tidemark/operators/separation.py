"""Are labelled states separable? Rank tests, effect sizes, overlaps, centroids and grades."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import config as cfg
from tidemark.functions import columns as fx
from tidemark.functions import tails
from tidemark.operators.ordered import average_ranks, exact_quantiles
from tidemark.operators.pairs import pair_statistics

L = F.lit
MEASURES = ("score", "Q", "A", "Gamma", "V")
MIN_CLASS = 20


def label_place(label: Column) -> Column:
    """Sort key of a label: the fixed order first, then by name."""
    known = fx.by_key(F.lower(label), {n: i for i, n in enumerate(cfg.LABEL_ORDER)}, L(len(cfg.LABEL_ORDER)))
    return F.struct(known.cast("int").alias("place"), F.lower(label).alias("name"))


def usable_labels(rows: DataFrame, keys: list[str], minimum: int = MIN_CLASS) -> DataFrame:
    counts = rows.groupBy(*keys, F.coalesce(F.col("label"), L("unknown")).alias("label")).agg(F.count(L(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy(label_place(F.col("label")))
    return counts.where(F.col("n") >= minimum).withColumn("place", F.row_number().over(order))


def measure_rows(rows: DataFrame, keys: list[str], measures=MEASURES) -> DataFrame:
    """Long form (keys, segment_id, label, measure, x) without missing values."""
    label = F.coalesce(F.col("label"), L("unknown")).alias("label")
    cells = F.array(*[F.struct(L(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in measures])
    return rows.select(*keys, label, F.inline(cells)).where(F.col("x").isNotNull())


def usable_measures(long: DataFrame, keys: list[str], primary: str = "score", minimum: int = MIN_CLASS) -> DataFrame:
    counts = long.groupBy(*keys, "measure").agg(F.count(L(1)).alias("n_values"))
    return counts.where((F.col("measure") == primary) | (F.col("n_values") >= minimum))


def kruskal(long: DataFrame, groups: list[str], label: str = "label", value: str = "x") -> DataFrame:
    """Tie-corrected H statistic and its p-value over the labels of each group."""
    ranks = average_ranks(long, groups, [label], value)
    per = ranks.groupBy(*groups, label).agg(
        F.sum("c").alias("n_j"), F.sum(F.col("c") * F.col("rank")).alias("r_j"), F.max("n").alias("n"),
        F.sum(F.col("c").cast("double") * (F.col("ties").cast("double") * F.col("ties") - L(1.0))).alias("t_j"))
    tot = per.groupBy(*groups).agg(
        F.max("n").alias("n"), F.count(L(1)).alias("k"), F.min("n_j").alias("smallest"), F.sum("t_j").alias("tie_term"),
        F.sum(F.col("r_j") * F.col("r_j") / F.col("n_j")).alias("s"))
    n = F.col("n").cast("double")
    raw = L(12.0) / (n * (n + 1)) * F.col("s") - L(3.0) * (n + 1)
    h = F.try_divide(raw, L(1.0) - F.try_divide(F.col("tie_term"), n * n * n - n))
    out = tot.select(*groups, "n", "k", "smallest", h.alias("h"))
    return out.withColumn("p_value", F.when(F.col("h").isNotNull() & (F.col("k") > 1), tails.kruskal_p("h", "k")))


def epsilon_squared(tests: DataFrame) -> DataFrame:
    """Adds epsilon squared = max((H - k + 1) / (n - k), 0)."""
    value = F.try_divide(F.col("h") - F.col("k") + L(1), F.col("n") - F.col("k"))
    return tests.withColumn("epsilon_squared", F.when(F.col("n") > F.col("k"), fx.positive(value)))


def label_pairs(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered label pairs per key from the small label table."""
    a = labels.select(*keys, F.col("label").alias("label_a"), F.col("place").alias("_pa"))
    b = labels.select(*keys, F.col("label").alias("label_b"), F.col("place").alias("_pb"))
    return a.join(b, keys).where(F.col("_pa") < F.col("_pb")).select(*keys, "label_a", "label_b").withColumn(
        "pair_key", F.concat_ws("__", "label_a", "label_b"))


def rank_sum(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Mann-Whitney U of side a against side b with the two-sided p-value."""
    ranks = average_ranks(rows, groups, ["side"], "x")
    is_a = F.col("side") == "a"
    agg = ranks.groupBy(*groups).agg(
        F.sum(F.when(is_a, F.col("c"))).alias("n_a"), F.sum(F.when(~is_a, F.col("c"))).alias("n_b"),
        F.sum(F.when(is_a, F.col("c") * F.col("rank"))).alias("r_a"),
        F.sum(F.col("c").cast("double") * (F.col("ties").cast("double") * F.col("ties") - L(1.0))).alias("tie_term"))
    u = F.col("r_a") - F.col("n_a") * (F.col("n_a") + L(1)) / L(2.0)
    return agg.where((F.col("n_a") >= 2) & (F.col("n_b") >= 2)).select(*groups, "n_a", "n_b", "tie_term", u.alias("u"))


def with_rank_sum_p(tests: DataFrame) -> DataFrame:
    """Adds the two-sided p-value of U. Python sees the rows of the test table only."""
    return tests.withColumn("p_value", tails.rank_sum_p("u", "n_a", "n_b", "tie_term"))


def holm(tests: DataFrame, groups: list[str], p: str, tie: str) -> DataFrame:
    """Holm-corrected p per group; a missing p counts as 1. ``tie`` fixes the order of equal p."""
    w = Window.partitionBy(*groups)
    df = tests.withColumn("_p", F.coalesce(F.col(p), L(1.0)))
    order = w.orderBy("_p", tie)
    m, rank = F.count(L(1)).over(w), F.row_number().over(order)
    df = df.withColumn("_adj", F.least(L(1.0), F.col("_p") * (m - rank + L(1))))
    running = F.max("_adj").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(f"{p}_holm", running).drop("_p", "_adj")


def grade(effect: Column, overlap: Column, p: Column) -> Column:
    """3 strong, 2 moderate, 1 weak, 0 none."""
    d = F.abs(effect)
    score = (
        F.when((p < 0.01) & (d >= 0.75) & (overlap <= 0.70), 3)
        .when((p < 0.05) & (d >= 0.35) & (overlap <= 0.85), 2)
        .when((p < 0.10) & ((d >= 0.20) | (overlap <= 0.92)), 1)
        .otherwise(0)
    )
    return F.when(effect.isNotNull() & overlap.isNotNull() & p.isNotNull(), score).otherwise(0)


GRADE_NAMES = {3: "strong", 2: "moderate", 1: "weak", 0: "none"}


def centroid_distances(rows: DataFrame, pairs: DataFrame, keys: list[str], measures=MEASURES) -> DataFrame:
    """Euclidean distance of label centroids after median / IQR scaling."""
    label = F.coalesce(F.col("label"), L("unknown")).alias("label")
    full = rows.select(*keys, label, *measures).dropna(subset=list(measures))
    sides = pairs.select(*keys, F.explode(F.array("label_a", "label_b")).alias("label")).distinct()
    full = full.join(sides, [*keys, "label"], "left_semi")
    long = full.select(*keys, "label", F.inline(F.array(*[F.struct(L(m).alias("measure"), F.col(m).alias("x")) for m in measures])))
    q = exact_quantiles(long, [*keys, "measure"], "x", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    means = long.groupBy(*keys, "label", "measure").agg(F.avg("x").alias("m")).join(q, [*keys, "measure"])
    iqr = F.col("q3") - F.col("q1")
    scaled = means.select(*keys, "label", "measure", ((F.col("m") - F.col("q2")) / F.when(iqr == 0, L(1.0)).otherwise(iqr)).alias("z"))
    a = scaled.select(*keys, "measure", F.col("label").alias("label_a"), F.col("z").alias("za"))
    b = scaled.select(*keys, "measure", F.col("label").alias("label_b"), F.col("z").alias("zb"))
    joined = pairs.join(a, [*keys, "label_a"]).join(b, [*keys, "measure", "label_b"])
    gap = F.col("zb") - F.col("za")
    return joined.groupBy(*keys, "pair_key").agg(F.sqrt(F.sum(gap * gap)).alias("centroid_distance"))


def pair_table(rows: DataFrame, keys: list[str], measures=MEASURES, minimum: int = MIN_CLASS, staging=None) -> DataFrame:
    """One row per (keys, measure, label pair) with tests, Holm correction and grade.

    ``staging`` writes the counted values, the tests and the centroid distances to tables, which keeps each plan short.
    """
    long = measure_rows(rows, keys, measures)
    long = long.join(usable_measures(long, keys, measures[0], minimum).drop("n_values"), [*keys, "measure"], "left_semi")
    labels = usable_labels(rows, keys, minimum)
    keep = staging or (lambda df, name: df)
    tests = keep(with_rank_sum_p(pair_statistics(long, labels, keys, staging=staging)), "tests")
    centroids = keep(centroid_distances(rows, label_pairs(labels, keys), keys, measures), "centroids")
    df = holm(tests, [*keys, "measure"], "p_value", "pair_key")
    df = df.withColumn("grade_score", grade(F.col("effect_size"), F.col("distribution_overlap"), F.col("p_value_holm")))
    df = df.withColumn("separation_grade", fx.by_key(F.col("grade_score"), GRADE_NAMES))
    return df.join(centroids, [*keys, "pair_key"], "left")


def pair_aggregate(graded: DataFrame, keys: list[str], primary: str = "score") -> DataFrame:
    """Support of each label pair over all measures."""
    agg = graded.groupBy(*keys, "pair_key", "label_a", "label_b").agg(
        F.count(F.when(F.col("grade_score") >= 2, 1)).alias("supported_measures"),
        F.coalesce(F.max(F.when(F.col("measure") == primary, F.col("grade_score"))), L(0)).alias("primary_measure_grade"),
        F.max("centroid_distance").alias("centroid_distance"))
    c = F.col("centroid_distance")
    agg = agg.withColumn("centroid_grade", F.when(c >= 1.25, 3).when(c >= 0.80, 2).when(c >= 0.45, 1).otherwise(0))
    m, p, g = F.col("supported_measures"), F.col("primary_measure_grade"), F.col("centroid_grade")
    agg = agg.withColumn("pair_supported", (p >= 2) | (m >= 2) | ((m >= 1) & (g >= 2)))
    score = F.when((p >= 3) | ((m >= 3) & (g >= 2)), 3).when(F.col("pair_supported"), 2).when((p >= 1) | (m >= 1) | (g >= 1), 1).otherwise(0)
    return agg.withColumn("grade_score", score).withColumn("separation_grade", fx.by_key(F.col("grade_score"), GRADE_NAMES))


def _largest_clique(labels: list[str], edges: set[tuple[str, str]]) -> list[str]:
    """Depth-first over sets in label order; a branch that cannot beat the best is left."""
    best: list[str] = []

    def grow(chosen: list[str], open_: list[str]) -> None:
        nonlocal best
        if len(chosen) > len(best):
            best = chosen
        for i, x in enumerate(open_):
            if len(chosen) + len(open_) - i <= len(best):
                return
            grow([*chosen, x], [y for y in open_[i + 1 :] if (x, y) in edges])

    grow([], labels)
    return best


@F.pandas_udf(T.ArrayType(T.StringType()))
def _clique(labels: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([_largest_clique(list(names), {*zip(a, b), *zip(b, a)}) for names, a, b in zip(labels, left, right)])


def largest_supported_set(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Largest set of labels that are all mutually supported; the first one in label order wins.

    Works on the supported pairs of one key, which are bounded by its labels, never on its rows.
    """
    supported = pairs.where("pair_supported")
    ends = F.array(*[F.struct(label_place(F.col(c)).alias("k"), F.col(c).alias("label")) for c in ("label_a", "label_b")])
    packed = supported.groupBy(*keys).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(ends)))).alias("nodes"), F.array_sort(F.collect_set(F.struct("label_a", "label_b"))).alias("edges"))
    labels = F.transform("nodes", lambda x: x["label"])
    chosen = _clique(labels, F.transform("edges", lambda e: e["label_a"]), F.transform("edges", lambda e: e["label_b"]))
    return packed.withColumn("labels", chosen).select(*keys, F.size("labels").cast("long").alias("set_size"), "labels")
