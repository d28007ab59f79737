"""Order-dependent building blocks that stay distributed when one key holds most rows.

Plain windows put a whole key into one task. Here a key is cut into buckets along its order
axis; counts per bucket (a small table) give every row its global position, and fixed-size chunks
with a short overlap replace the unbounded partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.staging import stage


def with_single_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attaches the columns of a one-row aggregate to every row (an ungrouped agg has one row)."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one").drop("_one")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on key columns in which NULL meets NULL."""
    theirs = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    return left.join(theirs, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], how).drop(*[f"_r_{k}" for k in keys])


def with_position(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "pos") -> DataFrame:
    """Adds the 0-based rank of each row inside its key.

    ``bucket`` must be a non-decreasing integer function of the first order column. Only rows of
    one (key, bucket) meet in a task; the per-key window runs over bucket counts alone.
    """
    rows = df.withColumn("_bucket", bucket.cast("long"))
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select(*keys, "_bucket", F.coalesce(before, F.lit(0)).alias("_base"))
    local = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return (
        null_safe_join(rows, base, [*keys, "_bucket"])
        .withColumn(name, F.col("_base") + local - F.lit(1))
        .drop("_bucket", "_base")
    )


def with_chunks(df: DataFrame, keys: list[str], position: str, chunk_rows: int, halo: int) -> DataFrame:
    """Cuts each key into chunks of ``chunk_rows``; the last ``halo`` rows are repeated in the next chunk.

    Adds ``_chunk`` and ``_halo`` (true for the repeated copies). Windows over (key, _chunk) then
    see at least ``halo`` preceding rows, and halo copies are filtered out afterwards.
    """
    if not 0 <= halo < chunk_rows:
        raise ValueError("halo must be smaller than the chunk")
    chunk = F.floor(F.col(position) / F.lit(chunk_rows)).cast("long")
    offset = F.col(position) % F.lit(chunk_rows)
    homes = F.when(offset >= chunk_rows - halo, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    out = df.select("*", F.explode(homes).alias("_chunk"))
    # a key that ends right before a chunk boundary yields an overlap-only chunk; it is dropped with the halo rows
    return out.withColumn("_halo", F.col("_chunk") != chunk)


def running_total(df: DataFrame, keys: list[str], position: str, value: Column, name: str, chunk_rows: int = 8192) -> DataFrame:
    """Inclusive running sum along ``position`` (0-based, dense enough to cut by value)."""
    rows = df.withColumn("_c", F.floor(F.col(position) / F.lit(chunk_rows)).cast("long")).withColumn("_v", value)
    sums = rows.groupBy(*keys, "_c").agg(F.sum("_v").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.select(*keys, "_c", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.sum("_v").over(Window.partitionBy(*keys, "_c").orderBy(position).rowsBetween(Window.unboundedPreceding, 0))
    return null_safe_join(rows, base, [*keys, "_c"]).withColumn(name, F.col("_before") + local).drop("_c", "_v", "_before")


#: Shares of a group at which its zones end: sixteenths, and thin zones at either end for outliers.
KNOTS = (0.0005, 0.005, *(i / 16 for i in range(1, 16)), 0.995, 0.9995)
ZONES = len(KNOTS) + 1


def _knots(value: str) -> Column:
    """Rough quantiles of a group: the borders of its zones. They only balance the bins; no result depends on them.

    They do depend on the order in which rows arrive, so a plan that reads them twice must read the same ones (``_extent``).
    """
    return F.percentile_approx(value, list(KNOTS), 10_000).alias("_knots")


def _extent(rows: DataFrame, groups: list[str], *aggs: Column) -> DataFrame:
    """One row per group, staged: counts of bins and the rows in them would not meet if each made its own borders."""
    return stage(rows.groupBy(*groups).agg(*aggs), "extent")


def _bin(bins: int) -> Column:
    """Non-decreasing bin of _v: its zone between rough quantiles, and an equal-width cell within the zone.

    An outlier or a tight cluster takes a zone of its own kind and leaves the cells of the other rows as they are.
    """
    cells = max(bins // ZONES, 1)
    zone = F.size(F.filter("_knots", lambda k: k <= F.col("_v")))
    low = F.when(zone == 0, F.col("_lo")).otherwise(F.get("_knots", zone - 1))
    high = F.when(zone == ZONES - 1, F.col("_hi")).otherwise(F.get("_knots", zone))
    cell = F.floor(F.try_divide(F.col("_v") - low, high - low) * F.lit(cells))
    return (zone * F.lit(cells) + F.coalesce(F.least(cell, F.lit(cells - 1)), F.lit(0))).cast("long")


def value_bins(df: DataFrame, groups: list[str], value: str, bins: int, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows with their bin (and the columns ``keep``), and per group the extremes, zone borders and counts. NULL groups are groups."""
    rows = df.select(*groups, *keep, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    extent = _extent(rows, groups, F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"), _knots("_v"))
    joined = null_safe_join(rows, extent, groups)
    return joined.withColumn("_bin", _bin(bins)).drop("_knots"), extent


def with_value_bin(df: DataFrame, groups: list[str], value: str, of: DataFrame, bins: int = 4096) -> DataFrame:
    """Adds ``_bin``, non-decreasing in the value. Its borders come from the rows of ``of``; NULL groups are groups."""
    extent = _extent(of, groups, F.min(value).alias("_lo"), F.max(value).alias("_hi"), _knots(value))
    rows = null_safe_join(df.withColumn("_v", F.col(value)), extent, groups)
    return rows.withColumn("_bin", _bin(bins)).drop("_v", "_lo", "_hi", "_knots")


def exact_quantiles(
    df: DataFrame, groups: list[str], value: str, fractions: dict[str, float], bins: int = 4096, left_out: tuple[str, list] | None = None
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per named fraction.

    A histogram pass finds the bins that hold the wanted ranks; only those bins are sorted, and
    equal values are merged before. No group is gathered in one task, unlike ``percentile``.

    ``left_out`` (a column and values of it): the quantiles of each group without the rows of a value, for each of the
    values. A row is binned and counted once, under its own value; the counts of the others are added up.
    """
    anchor = not groups
    if anchor:
        df, groups = df.withColumn("_g", F.lit(0)), ["_g"]
    own = [left_out[0]] if left_out else []
    rows, _ = value_bins(df, groups, value, bins, tuple(own))
    bare, groups = groups, [*groups, *own]

    def counted(of: DataFrame, by: list[str]) -> DataFrame:
        each = of.groupBy(*groups, *by).agg(F.count(F.lit(1)).alias("_c"))
        if not left_out:
            return each
        kind = df.schema[own[0]].dataType
        others = F.filter(F.array(*[F.lit(v).cast(kind) for v in left_out[1]]), lambda v: v != F.col(own[0]))
        return each.withColumn(own[0], F.explode(others)).groupBy(*groups, *by).agg(F.sum("_c").alias("_c"))

    if left_out:
        counts = counted(rows, ["_bin"]).withColumn("_n", F.sum("_c").over(Window.partitionBy(*groups)))
    else:
        counts = counted(rows, ["_bin", "_n"])
    order = Window.partitionBy(*groups).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    cumulative = counts.withColumn("_end", F.sum("_c").over(order)).withColumn("_start", F.col("_end") - F.col("_c"))
    wants = []
    for name, fraction in fractions.items():
        rank = F.lit(float(fraction)) * (F.col("_n") - F.lit(1))
        wants += [
            F.struct(F.lit(name).alias("q"), F.lit(0).alias("side"), F.floor(rank).alias("rank"), (rank - F.floor(rank)).alias("part")),
            F.struct(F.lit(name).alias("q"), F.lit(1).alias("side"), F.ceil(rank).alias("rank"), (rank - F.floor(rank)).alias("part")),
        ]
    targets = (
        cumulative.select("*", F.inline(F.array(*wants)))
        .where((F.col("rank") >= F.col("_start")) & (F.col("rank") < F.col("_end")))
        .select(*groups, "_bin", "q", "side", "part", (F.col("rank") - F.col("_start")).alias("_local"))
    )
    needed = targets.select(*bare, "_bin").distinct()
    inside = counted(null_safe_join(rows, needed, [*bare, "_bin"], "left_semi"), ["_bin", "_v"])
    by_value = Window.partitionBy(*groups, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_end", F.sum("_c").over(by_value)).withColumn("_start", F.col("_end") - F.col("_c"))
    picked = (
        null_safe_join(inside, targets, [*groups, "_bin"])
        .where((F.col("_local") >= F.col("_start")) & (F.col("_local") < F.col("_end")))
        .groupBy(*groups, "q")
        .agg(
            F.max(F.when(F.col("side") == 0, F.col("_v"))).alias("a"),
            F.max(F.when(F.col("side") == 1, F.col("_v"))).alias("b"),
            F.max("part").alias("p"),
        )
        .withColumn("x", F.col("a") + (F.col("b") - F.col("a")) * F.col("p"))
    )
    out = picked.groupBy(*groups).agg(*[F.max(F.when(F.col("q") == n, F.col("x"))).alias(n) for n in fractions])
    return out.drop("_g") if anchor else out


def average_ranks(df: DataFrame, groups: list[str], members: list[str], value: str, bins: int = 4096) -> DataFrame:
    """Average ranks (ties share the mean rank) per group over distinct values.

    Returns one row per (group, members, value): count ``c`` of the member at that value, ``rank``
    the average rank of the value in its group, ``ties`` its total count, ``n`` the group size.
    """
    pooled = (
        df.select(*groups, *members, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
        .groupBy(*groups, *members, "_v").agg(F.count(F.lit(1)).alias("c"))
    )
    extent = _extent(pooled, groups, F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("c").alias("n"), _knots("_v"))
    joined = null_safe_join(pooled, extent, groups).withColumn("_bin", _bin(bins)).drop("_knots")
    counts = joined.groupBy(*groups, "_bin").agg(F.sum("c").alias("_k"))
    before = F.sum("_k").over(Window.partitionBy(*groups).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select(*groups, "_bin", F.coalesce(before, F.lit(0)).alias("_base"))
    peers = Window.partitionBy(*groups, "_bin").orderBy("_v")
    upto = F.sum("c").over(peers)  # range frame: includes every row with the same value
    same = F.sum("c").over(Window.partitionBy(*groups, "_bin", "_v"))
    out = null_safe_join(joined, base, [*groups, "_bin"]).withColumn("ties", same).withColumn("_upto", F.col("_base") + upto)
    rank = F.col("_upto") - F.col("ties") + (F.col("ties") + F.lit(1)) / F.lit(2.0)
    return out.select(*groups, *members, F.col("_v").alias(value), "c", "ties", rank.alias("rank"), "n")
