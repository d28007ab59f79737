"""Statistics of all label pairs from one table of value counts.

Each (keys, measure) group is put in order of value once. Running counts of every label then give, at each value, how many
rows of any other label lie below it, so no row is repeated for the pairs its label belongs to. The borders of the pairs'
histograms travel through the same order as marks that count nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.operators.compare import pooled_d
from tidemark.operators.ordered import null_safe_join, with_value_bin

L = F.lit
#: Labels whose running counts are columns of one pass; more labels take more passes.
BLOCK = 16


def placed_values(long: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, place, label, x) of the usable labels, without NULL and NaN values."""
    placed = null_safe_join(long, labels.select(*keys, "label", "place"), [*keys, "label"])
    return placed.where(F.col("x").isNotNull() & ~F.isnan("x")).select(*keys, "measure", "place", "label", "x")


def _pairs(placed: DataFrame, groups: list[str]) -> DataFrame:
    """Pairs of labels with their moments and joint range: a few rows per group, whatever its size."""
    shown = ("place", "label", "n", "mean", "var", "lo", "hi")
    stats = placed.groupBy(*groups, "place", "label").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    packed = stats.where("n >= 2").groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct(*shown))).alias("_l"))
    both = packed.select(*groups, "_l", F.explode("_l").alias("a")).select(*groups, "a", F.explode("_l").alias("b")).where("a.place < b.place")
    sides = [F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in shown[:5]]
    return both.select(*groups, *sides, F.least("a.lo", "b.lo").alias("lo"), F.greatest("a.hi", "b.hi").alias("hi"))


def _borders(pairs: DataFrame, groups: list[str], bins: int) -> DataFrame:
    """Inner borders of each pair's histogram, as rows of the value table without a label and without a count."""
    step = (F.col("hi") - F.col("lo")) / L(float(bins))
    marks = F.transform(F.sequence(L(1), L(bins - 1)), lambda i: F.struct(i.alias("border"), (F.col("lo") + i * step).alias("x")))
    return pairs.where("lo < hi").select(*groups, "place_a", "place_b", F.inline(marks)).withColumn("c", L(0).cast("long"))


def _ties(count: Column) -> Column:
    t = count.cast("double")
    return t * (t * t - L(1.0))


def _pass(rows: DataFrame, groups: list[str], block: range) -> DataFrame:
    """Sums of one block of labels per pair and border: wins and ties of label rows, counts below each border."""
    mine = {j: F.when(F.col("place") == j, F.col("c")).otherwise(L(0)) for j in block}
    cells = rows.groupBy(*groups, "_bin").agg(*[F.sum(mine[j]).alias(f"_n{j}") for j in block])
    earlier = Window.partitionBy(*groups).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*groups, "_bin", *[F.coalesce(F.sum(f"_n{j}").over(earlier), L(0)).alias(f"_b{j}") for j in block])
    order = Window.partitionBy(*groups, "_bin").orderBy("x")
    equal = order.rangeBetween(Window.currentRow, Window.currentRow)
    seen = null_safe_join(rows, cells, [*groups, "_bin"]).select(
        "*", *[F.sum(mine[j]).over(order).alias(f"_u{j}") for j in block], *[F.sum(mine[j]).over(equal).alias(f"_s{j}") for j in block])
    c, place = F.col("c"), F.col("place")
    sums = []
    for j in block:
        below, same = F.col(f"_b{j}") + F.col(f"_u{j}") - F.col(f"_s{j}"), F.col(f"_s{j}")
        tied = F.when(same == 0, _ties(c)).when(place < j, _ties(c + same)).otherwise(L(0.0))
        sums += [F.sum(c * (below + same / L(2.0))).alias(f"_w{j}"), F.sum(tied).alias(f"_t{j}"), F.max(below).alias(f"_f{j}")]
    per = seen.groupBy(*groups, "place", "place_a", "place_b", "border").agg(*sums)

    def other(j: int) -> Column:
        first, second = place < j, place > j
        return F.struct(
            F.least(place, L(j)).alias("place_a"), F.greatest(place, L(j)).alias("place_b"), L(None).cast("int").alias("border"),
            F.when(first, F.col(f"_w{j}")).alias("u"), F.when(first | second, F.col(f"_t{j}")).alias("ties"),
            L(None).cast("long").alias("f_a"), L(None).cast("long").alias("f_b"))

    below_at = F.array(*[F.col(f"_f{j}") for j in block])
    mark = F.struct(
        F.col("place_a"), F.col("place_b"), F.col("border"), L(None).cast("double").alias("u"), L(None).cast("double").alias("ties"),
        F.get(below_at, F.col("place_a") - L(block.start)).alias("f_a"), F.get(below_at, F.col("place_b") - L(block.start)).alias("f_b"))
    return per.select(*groups, F.inline(F.when(place.isNull(), F.array(mark)).otherwise(F.array(*[other(j) for j in block]))))


def _overlap(bins: int) -> Column:
    """Shared mass of two histograms from the counts below their inner borders; NULL where all values are equal."""
    a = F.concat(F.array(L(0).cast("long")), F.transform("marks", lambda m: m["f_a"]), F.array(F.col("n_a")))
    b = F.concat(F.array(L(0).cast("long")), F.transform("marks", lambda m: m["f_b"]), F.array(F.col("n_b")))
    share = lambda f, n, i: (F.get(f, i + L(1)) - F.get(f, i)) / F.col(n)
    total = F.aggregate(F.sequence(L(0), L(bins - 1)), L(0.0), lambda acc, i: acc + F.least(share(a, "n_a", i), share(b, "n_b", i)))
    return F.when(F.col("lo") < F.col("hi"), total)


def pair_statistics(long: DataFrame, labels: DataFrame, keys: list[str], bins: int = cfg.PAIR_HISTOGRAM_BINS, staging=None) -> DataFrame:
    """One row per (keys, measure, pair of usable labels) that has two values or more on both sides.

    ``long`` holds (keys, label, measure, x), ``labels`` the usable labels with their place. Returns counts, means, their
    difference (b - a), Cohen's d (b - a), the overlap of histograms, U of the first label and the tie term. NULL keys are
    keys; NULL and NaN values take no part; an empty table gives no rows. ``staging`` writes the counted values to a table that
    every pass reads; without it a pass counts them again. One number, the most labels of a key, is read
    by the driver: it sets the number of passes.
    """
    groups = [*keys, "measure"]
    placed = placed_values(long, labels, keys)
    pairs = _pairs(placed, groups)
    values = placed.groupBy(*groups, "place", "x").agg(F.count(L(1)).alias("c"))
    rows = with_value_bin(values.unionByName(_borders(pairs, groups, bins), allowMissingColumns=True), groups, "x", placed)
    rows = staging(rows, "values") if staging else rows
    most = labels.agg(F.max("place")).first()[0] or 1
    passes = [_pass(rows, groups, range(s, min(s + BLOCK, most + 1))) for s in range(1, most + 1, BLOCK)]
    parts = passes[0]
    for more in passes[1:]:
        parts = parts.unionByName(more)
    at = [*groups, "place_a", "place_b"]
    parts = parts.groupBy(*at, "border").agg(*[F.sum(c).alias(c) for c in ("u", "ties", "f_a", "f_b")])
    mark = F.when(F.col("border").isNotNull(), F.struct("border", "f_a", "f_b"))
    folded = parts.groupBy(*at).agg(F.sum("u").alias("u"), F.sum("ties").alias("tie_term"), F.array_sort(F.collect_list(mark)).alias("marks"))
    df = null_safe_join(pairs, folded, at)
    d = pooled_d(*[F.col(f"{n}_b") for n in ("n", "mean", "var")], *[F.col(f"{n}_a") for n in ("n", "mean", "var")])
    return df.select(
        *groups, F.concat_ws("__", "label_a", "label_b").alias("pair_key"), "label_a", "label_b", "n_a", "n_b", "mean_a", "mean_b",
        (F.col("mean_b") - F.col("mean_a")).alias("mean_diff"), d.alias("effect_size"), _overlap(bins).alias("distribution_overlap"), "u", "tie_term")
