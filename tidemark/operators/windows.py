"""Cutting recordings, trials and label tracks into windows; range joins; segment records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.functions import columns as fx
from tidemark.operators.ordered import running_total, with_chunks, with_position

L = F.lit


def half_even(x: Column) -> Column:
    """Rounding to the nearest integer with ties to even."""
    return F.bround(x).cast("long")


def segment_bounds(df: DataFrame, n: Column, fs: Column, window_s: Column, step_s: Column) -> DataFrame:
    """One row per fixed window: start, end (samples), start_s, end_s, window_index. The tail is dropped."""
    df = df.withColumns({"_n": n.cast("long"), "_fs": fs.cast("double"), "_w": half_even(window_s * fs), "_s": half_even(step_s * fs)})
    ok = (F.col("_n") > 0) & (F.col("_fs") > 0) & (F.col("_w") > 0) & (F.col("_s") > 0) & (F.col("_n") >= F.col("_w"))
    starts = F.when(ok, F.sequence(L(0).cast("long"), F.col("_n") - F.col("_w"), F.col("_s")))
    df = df.select("*", F.posexplode(starts).alias("window_index", "start"))
    df = df.withColumn("end", F.col("start") + F.col("_w"))
    return df.withColumns({"start_s": F.col("start") / F.col("_fs"), "end_s": F.col("end") / F.col("_fs")}).drop("_n", "_fs", "_w", "_s")


def default_windows(dataset: Column, dynamic: bool = False) -> tuple[Column, Column]:
    """Window length and step in seconds of a dataset, NULL for one without defaults."""
    table = cfg.DYNAMIC_WINDOWS if dynamic else cfg.STATIC_WINDOWS
    known = F.create_map(*[x for d, (length, step) in table.items() for x in (L(d), F.struct(L(length).alias("length"), L(step).alias("step")))])
    found = F.try_element_at(known, F.lower(dataset))
    return found["length"], found["step"]


def slice_signal(samples: Column, start: Column, end: Column) -> Column:
    """Samples start..end-1 of an array (0-based, end exclusive)."""
    return F.slice(samples, (start + L(1)).cast("int"), (end - start).cast("int"))


def segment_record(df: DataFrame, **fields: Column) -> DataFrame:
    """Canonical segment columns; missing ones are typed NULLs, duration is end - start."""
    text = ("subject_id", "segment_id", "dataset", "label", "source_record_id")
    cols = {n: fields.get(n, L(None)).cast("string") for n in text}
    cols |= {n: fields.get(n, L(None)).cast("double") for n in ("window_start_sec", "window_end_sec")}
    cols["segment_duration_sec"] = cols["window_end_sec"] - cols["window_start_sec"]
    cols["sampling_rates"] = fields.get("sampling_rates", L(None)).cast("map<string,double>")
    cols["self_report"] = fields.get("self_report", L(None)).cast("map<string,double>")
    cols["metadata"] = fields.get("metadata", L(None)).cast("map<string,string>")
    return df.select(*[c.alias(n) for n, c in cols.items()])


def label_runs(track: DataFrame, key: str = "recording_id", chunk_rows: int = 65536) -> DataFrame:
    """Maximal runs of equal label code over consecutive rows (gaps and islands) without a window over a whole recording.

    Rows are compared with the row before, whatever its sample index, so a missing sample splits no run. Rows without a
    label make runs of their own.
    """
    placed = with_position(track, [key], ["i"], F.floor(F.col("i") / L(chunk_rows)))
    df = with_chunks(placed, [key], "pos", chunk_rows, 1)
    previous = F.lag("label_code").over(Window.partitionBy(key, "_chunk").orderBy("pos"))
    df = df.withColumn("_new", ((F.col("pos") == 0) | ~previous.eqNullSafe(F.col("label_code"))).cast("int")).where(~F.col("_halo")).drop("_chunk", "_halo")
    df = running_total(df, [key], "pos", F.col("_new"), "run_no", chunk_rows)
    return df.groupBy(key, "run_no").agg(
        F.first("label_code").alias("label_code"), F.min("i").alias("run_start"), (F.max("i") + L(1)).alias("run_end"))


def label_run_windows(
    track: DataFrame, fs: float, window_s: float, step_s: float, kept=cfg.KEPT_TRACK_LABELS, key: str = "recording_id"
) -> DataFrame:
    """Windows inside kept label runs; times are offset by the run start, run index counts kept runs."""
    runs = label_runs(track, key).withColumn("label", fx.by_key(F.col("label_code"), cfg.TRACK_LABELS))
    runs = runs.where(F.col("label").isin(*kept))
    runs = with_position(runs, [key], ["run_start"], F.floor(F.col("run_start") / L(1 << 20)), "run_index")
    out = segment_bounds(runs, F.col("run_end") - F.col("run_start"), L(fs), L(window_s), L(step_s))
    offset = F.col("run_start") / L(fs)
    return out.select(
        key, "label", "run_index", "window_index", (F.col("run_start") + F.col("start")).alias("start"), (F.col("run_start") + F.col("end")).alias("end"),
        (offset + F.col("start_s")).alias("window_start_sec"), (offset + F.col("end_s")).alias("window_end_sec"))


def trim_to_shortest(df: DataFrame, arrays: list[str]) -> DataFrame:
    """All arrays cut to the length of the shortest one."""
    shortest = F.least(*[F.size(a) for a in arrays])
    return df.withColumn("_k", shortest).withColumns({a: F.slice(a, L(1), F.col("_k")) for a in arrays}).drop("_k")


def mean_lead(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Multi-lead signal collapsed to the mean lead per sample."""
    return samples.groupBy(*keys, "i").agg(F.avg("v").alias("v"))


def trial_windows(trials: DataFrame, fs: float, n: Column, trim_s: float, window_s: float, step_s: float) -> DataFrame:
    """Trials cut after dropping the first seconds; times are shifted by the trim; label from the scores."""
    trim = int(round(trim_s * fs))
    out = segment_bounds(trials, n - L(trim), L(fs), L(window_s), L(step_s))
    return out.withColumns({
        "start": F.col("start") + L(trim), "end": F.col("end") + L(trim),
        "window_start_sec": F.col("start_s") + L(trim_s), "window_end_sec": F.col("end_s") + L(trim_s),
        "label": fx.state_label(F.col("dataset"), F.col("valence"), F.col("arousal")),
    }).drop("start_s", "end_s")


def dual_rate_windows(trials: DataFrame, n: Column, fs: float, other_fs: float, window_s: float, step_s: float) -> DataFrame:
    """Windows on the first clock with the matching sample range on a second clock."""
    out = segment_bounds(trials, n, L(fs), L(window_s), L(step_s))
    return out.withColumns({"other_start": half_even(F.col("start_s") * L(other_fs)), "other_end": half_even(F.col("end_s") * L(other_fs))})


# --- physical units and lookups ---------------------------------------------------------------

# Fixed values: (gain, offset) of the volt-to-unit conversions and the joystick range.
VOLT_UNITS = {"bvp": (58.962, -115.09), "gsr": (24.0, -49.2), "resp": (58.923, -115.01), "temp": (21.341, -32.085)}
JOYSTICK = (26225.0, 52450.0)
# End of fixed values.


def physical_units(daq: DataFrame) -> DataFrame:
    """Volts to units; time to milliseconds; ECG to millivolts."""
    cols = {k: L(g) * F.col(f"{k}_v") + L(o) for k, (g, o) in VOLT_UNITS.items()}
    cols["ecg"] = (F.col("ecg_v") - L(2.8)) / L(50.0) * L(1000.0)
    cols["t_ms"] = F.col("t_s") * L(1000.0)
    return daq.withColumns(cols)


def joystick_score(v: Column) -> Column:
    return L(0.5) + L(9.0) * (v + L(JOYSTICK[0])) / L(JOYSTICK[1])


def normal_text(c: Column) -> Column:
    return F.lower(F.trim(c))


def stimulus_order(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Wide order table (one column per subject, one row per place) to ordered stimuli, blanks dropped."""
    long = wide.unpivot(["place"], columns, "subject_id", "stimulus")
    long = long.withColumn("stimulus", normal_text(F.col("stimulus"))).where(F.col("stimulus").isNotNull() & (F.col("stimulus") != ""))
    return long


def stimulus_offsets(order: DataFrame, durations: DataFrame, bucket: Column, key: str = "subject_id", place: str = "position") -> DataFrame:
    """Start offset of every stimulus with a known duration: running sum of the earlier durations."""
    df = order.withColumn("stimulus", normal_text(F.col("stimulus"))).join(durations, "stimulus")
    df = with_position(df, [key], [place], bucket, "nth")
    df = running_total(df, [key], "nth", F.col("duration_s"), "_end_s")
    df = df.withColumn("start_s", F.col("_end_s") - F.col("duration_s")).drop("_end_s", "nth")
    return df.withColumn("label", F.coalesce(fx.by_key(F.col("stimulus"), cfg.STIMULUS_LABELS), L("disbalance")))


def interval_windows(intervals: DataFrame, start: str, end: str, window_s: float, step_s: float) -> DataFrame:
    """Windows that begin at the interval start and end no later than the interval end (+1e-6)."""
    count = F.floor((F.col(end) - F.col(start) - L(window_s) + L(1e-6)) / L(step_s)).cast("long")
    index = F.explode(F.when(count >= 0, F.sequence(L(0).cast("long"), count)))
    df = intervals.select("*", index.alias("window_index"))
    begin = F.col(start) + F.col("window_index") * L(step_s)
    return df.withColumns({"window_start_sec": begin, "window_end_sec": begin + L(window_s)})


def range_join(points: DataFrame, intervals: DataFrame, keys: list[str], t: str, start: str, end: str, bucket: float, *, closed: bool = True) -> DataFrame:
    """Points inside intervals by an equi-join on (keys, time bucket) and an exact filter.

    An interval is repeated once per bucket it touches, so its length over ``bucket`` bounds the
    repetition; a busy key spreads over its buckets.
    """
    p = points.withColumn("_b", F.floor(F.col(t) / L(bucket)).cast("long"))
    cells = F.sequence(F.floor(F.col(start) / L(bucket)).cast("long"), F.floor(F.col(end) / L(bucket)).cast("long"))
    i = intervals.select("*", F.explode(cells).alias("_b"))
    inside = (F.col(t) >= F.col(start)) & ((F.col(t) <= F.col(end)) if closed else (F.col(t) < F.col(end)))
    return p.join(i, [*keys, "_b"]).where(inside).drop("_b")


def enough_samples(windows: DataFrame, samples: DataFrame, keys: list[str], t: str, bucket: float, minimum: int = cfg.MIN_SIGNAL_SAMPLES) -> DataFrame:
    """Windows that hold at least ``minimum`` sample times (both ends count); the others keep their index out of use."""
    ids = [*keys, "window_start_sec", "window_end_sec"]
    inside = range_join(samples.select(*keys, t), windows.select(*ids).distinct(), keys, t, "window_start_sec", "window_end_sec", bucket)
    held = inside.groupBy(*ids).agg(F.count(L(1)).alias("_n")).where(F.col("_n") >= minimum).drop("_n")
    return windows.join(held, ids, "left_semi")


# --- trial events -----------------------------------------------------------------------------

def target_events(events: DataFrame, keys: list[str] | None = None, tie: tuple[str, ...] = (), bucket: float = 600.0) -> DataFrame:
    """Numeric cast; trial types 1..9 with onset and duration.

    With ``keys`` adds ``trial_index``, the 0-based place of a trial in its recording by (onset, type, ``tie``). ``bucket``
    (seconds of onset) cuts a long recording, so that no task orders all of it.
    """
    df = events.withColumns({n: F.col(n).try_cast("double") for n in ("onset", "duration")} | {"trial_type": F.col("trial_type").try_cast("double")})
    kept = df.where(F.col("trial_type").between(1, 9) & F.col("onset").isNotNull() & F.col("duration").isNotNull())
    kept = kept.withColumn("trial_type", F.col("trial_type").cast("int"))
    if keys is None:
        return kept
    return with_position(kept, keys, ["onset", "trial_type", *tie], F.floor(F.col("onset") / L(bucket)), "trial_index")


def event_sample_range(events: DataFrame, fs: Column, n: Column, minimum: int = cfg.MIN_SIGNAL_SAMPLES) -> DataFrame:
    """Sample range of an event inside the recording; short ranges are dropped."""
    df = events.withColumns({
        "start": F.greatest(half_even(F.col("onset") * fs), L(0).cast("long")),
        "end": F.least(half_even((F.col("onset") + F.col("duration")) * fs), n.cast("long")),
    })
    return df.where(F.col("end") - F.col("start") >= minimum)


def target_centroid(trial_type: Column) -> tuple[Column, Column, Column]:
    """Target valence, arousal and name of a trial type on the 3 x 3 grid."""
    zero = trial_type - L(1)
    levels = F.array(*[L(x) for x in cfg.TARGET_LEVELS])
    ok = trial_type.between(1, 9)
    name = F.element_at(F.array(*[L(x) for x in cfg.TARGET_NAMES]), trial_type.cast("int"))
    return (
        F.when(ok, F.element_at(levels, (zero % 3 + 1).cast("int"))),
        F.when(ok, F.element_at(levels, (F.floor(zero / 3) + 1).cast("int"))),
        F.when(ok, name),
    )


def ids_from_path(path: Column) -> dict[str, Column]:
    pick = lambda pattern: F.nullif(F.regexp_extract(path, pattern, 1), L(""))
    number = pick(r"(?i)(?:sub-|subject|s)[_-]?(\d{1,3})")
    return {
        "subject": pick(r"sub-([A-Za-z0-9]+)"), "session": pick(r"ses-([A-Za-z0-9]+)"), "run": pick(r"task-(run\d+)"),
        "subject_code": F.when(number.isNotNull(), F.concat(L("S"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number))),
    }


def self_report_lookup(reports: DataFrame, order: str) -> DataFrame:
    """Normalises free column names, finds the needed ones by substring; the last duplicate wins."""
    found = {}
    for column in reports.columns:
        plain = column.strip().lower().replace(" ", "_").replace("-", "_")
        for want in ("subject", "phase", "valence", "arousal"):
            if want in plain and want not in found:
                found[want] = column
    df = reports.select(*[F.col(f"`{c}`").alias(w) for w, c in found.items()], F.col(order).alias("_order"))
    df = df.withColumn("phase", normal_text(F.col("phase")))
    return df.groupBy("subject", "phase").agg(F.max_by(F.struct("valence", "arousal"), "_order").alias("r")).select("subject", "phase", "r.valence", "r.arousal")


def label_from_text(text: Column) -> Column:
    t = F.lower(text)
    return (
        F.when(t.rlike("stress|mmst|arousal_high"), "stress").when(t.rlike("calm|baseline|rest"), "baseline").otherwise("disbalance")
    )


def epoch_segments(epochs: DataFrame, duration_s: float) -> DataFrame:
    """Epoch rows to segments: label by metadata, then scores, then event name, then file stem."""
    scored = F.col("valence").isNotNull() & F.col("arousal").isNotNull()
    meta = F.nullif(F.trim(F.col("label")), L(""))
    label = (
        F.when(meta.isNotNull(), label_from_text(meta))
        .when(scored, fx.state_label(F.col("dataset"), F.col("valence"), F.col("arousal")))
        .when(F.nullif(F.col("event_name"), L("")).isNotNull(), label_from_text(F.col("event_name")))
        .otherwise(label_from_text(F.col("file_stem")))
    )
    phase = F.coalesce(F.nullif(normal_text(F.col("phase")), L("")), F.nullif(normal_text(F.col("event_name")), L("")), normal_text(F.col("file_stem")))
    return epochs.withColumns({
        "state": label, "phase_name": phase, "window_start_sec": F.col("epoch_index") * L(float(duration_s)),
        "window_end_sec": (F.col("epoch_index") + L(1)) * L(float(duration_s))})


def with_fallback_signal(segments: DataFrame, fallback: DataFrame, keys: list[str], column: str = "ecg") -> DataFrame:
    """Signal from the fallback table where the main one has none."""
    other = fallback.select(*keys, F.col(column).alias("_fallback"))
    return segments.join(other, keys, "left").withColumn(column, F.coalesce(column, "_fallback")).drop("_fallback")


def resolved_duration(samples_size: Column | None = None, rate: Column | None = None) -> Column:
    """Field, else end - start, else sample count over rate."""
    chain = [
        F.when(F.col("segment_duration_sec") > 0, F.col("segment_duration_sec")),
        F.when(F.col("window_end_sec") > F.col("window_start_sec"), F.col("window_end_sec") - F.col("window_start_sec")),
    ]
    if samples_size is not None:
        chain.append(F.when((rate > 0) & (samples_size > 0), F.try_divide(samples_size, rate)))
    return F.coalesce(*chain)


def expand_segments(segments: DataFrame, window_s: float, step_s: float, duration: Column | None = None) -> DataFrame:
    """Cuts long segments into sub-windows on a 1000 Hz clock; short ones are kept as they are."""
    df = segments.withColumn("_d", resolved_duration() if duration is None else duration)
    split = F.coalesce(F.col("_d") > L(float(window_s)), L(False))
    width, step = int(round(window_s * 1000)), int(round(step_s * 1000))
    n = half_even(F.col("_d") * L(1000.0))
    starts = F.when(split & (n >= width), F.sequence(L(0).cast("long"), n - L(width), L(step).cast("long"))).otherwise(F.array(L(None).cast("long")))
    df = df.select("*", F.posexplode(starts).alias("_i", "_s"))
    sub = F.col("_s").isNotNull()
    origin = F.coalesce("window_start_sec", L(0.0))
    limit = F.coalesce(F.col("window_end_sec"), origin + F.col("_d"))
    begin = origin + F.col("_s") / L(1000.0)
    stop = F.least(origin + (F.col("_s") + L(width)) / L(1000.0), limit)
    return df.withColumns({
        "parent_segment_id": F.when(sub, F.col("segment_id")), "dynamic_window_index": F.when(sub, F.col("_i")),
        "local_start_sec": F.when(sub, F.col("_s") / L(1000.0)), "local_end_sec": F.when(sub, (F.col("_s") + L(width)) / L(1000.0)),
        "segment_id": F.when(sub, F.format_string("%s_dyn%03d", "segment_id", "_i")).otherwise(F.col("segment_id")),
        "segment_duration_sec": F.when(sub, stop - begin).otherwise(F.col("segment_duration_sec")),
        "window_end_sec": F.when(sub, stop).otherwise(F.col("window_end_sec")),
        "window_start_sec": F.when(sub, begin).otherwise(F.col("window_start_sec")),
    }).drop("_d", "_i", "_s")


def slice_sub_window(samples: Column, rate: Column) -> Column:
    """The part of a parent signal that belongs to an expanded sub-window, at the signal's own rate."""
    start = F.greatest(half_even(F.col("local_start_sec") * rate), L(0).cast("long"))
    end = F.least(F.greatest(half_even(F.col("local_end_sec") * rate), start), F.size(samples).cast("long"))
    return F.when(F.col("local_start_sec").isNotNull() & (rate > 0), slice_signal(samples, start, end)).otherwise(samples)


def quarantine(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows and the rest, so that a bad recording does not stop the job."""
    ok = F.coalesce(valid, L(False))
    return df.where(ok), df.where(~ok)


def discover_runs(names: DataFrame, column: str = "name") -> DataFrame:
    """Distinct (dataset, mode) pairs from result names results_<dataset>_<mode>."""
    pattern = r"^results_(.+)_(strict|proxy|hybrid)$"
    df = names.select(F.regexp_extract(column, pattern, 1).alias("dataset"), F.regexp_extract(column, pattern, 2).alias("mode"))
    return df.where(F.col("mode") != "").distinct()
