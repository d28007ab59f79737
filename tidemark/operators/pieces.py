"""Signals as pieces: recordings of any length are cut along windows without gathering a recording in one row.

A piece is a row with the recording's keys, ``signal``, ``channel``, ``rate``, ``first`` (index of its first sample in the
recording) and ``samples``. Pieces of a signal may have any lengths, do not overlap and leave no gap inside a recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.operators.ordered import null_safe_join
from tidemark.operators.windows import half_even

L = F.lit
#: Samples of a slot: pieces and windows meet by recording, signal and slot, so a long recording is many join keys.
SLOT = 1 << 14

# The EEG channels come first, then these signals by their place among the peripheral channels.
PERIPHERAL_SIGNALS = {4: "gsr", 5: "respiration", 6: "ppg", 7: "temperature"}
# End of fixed values.


def deap_signals(pieces: DataFrame) -> DataFrame:
    """Names ``signal`` and ``channel`` by ``position`` (0-based place of the channel in a trial).

    The first 32 are EEG, the next eight peripheral channels; those without a signal of their own are "peripheral". A
    position beyond these, or none, has no row in the result.
    """
    n = len(cfg.DEAP_CHANNELS)
    rows = [("eeg", c) for c in cfg.DEAP_CHANNELS] + [(PERIPHERAL_SIGNALS.get(i, "peripheral"), c) for i, c in enumerate(cfg.DEAP_PERIPHERAL)]
    place = F.get(F.array(*[F.struct(L(s).alias("signal"), L(c).alias("channel")) for s, c in rows]), F.col("position").cast("int"))
    known = pieces.where(F.col("position").between(0, n + len(cfg.DEAP_PERIPHERAL) - 1)).drop("signal", "channel")
    return known.select("*", place.alias("_place")).select(*known.columns, "_place.signal", "_place.channel")


def _slots(first: Column, stop: Column, slot: int) -> Column:
    """The slots that samples first..stop-1 touch; none if there are no samples."""
    return F.when(stop > first, F.sequence(F.floor(first / slot).cast("long"), F.floor((stop - 1) / slot).cast("long")))


def cut_signals(pieces: DataFrame, windows: DataFrame, keys: list[str], window: str, start_s: str, end_s: str, slot: int = SLOT) -> DataFrame:
    """Every signal of a recording cut along the recording's windows, each at its own rate.

    Gives keys, window, signal, channel, rate, start, end (sample indices, end exclusive, as the window asks for them) and
    ``samples``: those the recording has between them, empty if it has none there. ``window`` names the id of a window,
    unique in its recording. Bounds are seconds times rate, halves to even, not below 0; an end before its start is the
    start. A NULL bound is that end of the recording, so a segment that was not split keeps its whole signals. Signals
    without a positive rate cannot be cut: they come once a window with NULL bounds and samples, their pieces stay
    the whole signal. NULL keys and channels are values like others. Windows of recordings without pieces have no
    row. Only the part of a piece that a window holds is shuffled; what a window holds is one row.
    """
    names = [*keys, "signal", "channel"]
    held = pieces.select(*names, F.col("rate").cast("double").alias("rate"), F.col("first").cast("long").alias("first"), F.col("samples").cast("array<double>").alias("samples"))
    stop = F.col("first") + F.size("samples")
    signals = held.groupBy(*names, "rate").agg(F.max(stop).alias("_n"))
    asked = windows.select(*keys, window, F.col(start_s).cast("double").alias("_from"), F.col(end_s).cast("double").alias("_to"))
    known = F.coalesce(F.col("rate") > 0, L(False))
    start = F.greatest(half_even(F.coalesce("_from", L(0.0)) * F.col("rate")), L(0).cast("long"))
    end = F.when(F.col("_to").isNull(), F.greatest("_n", "start")).otherwise(F.greatest(half_even(F.col("_to") * F.col("rate")), F.col("start")))
    ranges = null_safe_join(asked, signals, keys).withColumn("start", F.when(known, start)).withColumn("end", F.when(known, end))
    ranges = ranges.select(*names, window, "rate", "start", "end", F.explode_outer(_slots(F.col("start"), F.least("end", "_n"), slot)).alias("_slot"))
    parts = held.where(known).select("*", F.explode(_slots(F.col("first"), stop, slot)).alias("_slot"))
    meet = null_safe_join(ranges, parts.withColumnRenamed("rate", "_rate"), [*names, "_slot"], "left")
    # a slot's part of a piece's part of a window: no sample comes twice, wherever pieces and slots end
    low = F.greatest("start", "first", F.col("_slot") * slot)
    high = F.least("end", F.col("first") + F.size("samples"), (F.col("_slot") + 1) * slot)
    part = F.when(F.col("first").isNotNull() & (high > low), F.struct(low.alias("at"), F.slice("samples", (low - F.col("first") + 1).cast("int"), F.greatest(high - low, L(0)).cast("int")).alias("part")))
    rows = meet.select(*names, window, "rate", "start", "end", part.alias("_part"))
    groups = rows.groupBy(*names, window, "rate", "start", "end").agg(F.sort_array(F.collect_list("_part")).alias("_parts"))
    samples = F.when(F.col("start").isNotNull(), F.flatten(F.transform("_parts", lambda p: p["part"])))
    return groups.withColumn("samples", samples).drop("_parts")
