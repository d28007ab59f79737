"""Registered queries: sources, windowing and signal features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.functions import columns as fx
from tidemark.operators import pieces as pc
from tidemark.operators import signals as sg
from tidemark.operators import windows as wd
from tidemark.plans.output import finish
from tidemark.plans.scoring import features
from tidemark.plans.staging import stage
from tidemark.session import small_batches
from tidemark.sources.tables import fixture, table

L = F.lit
FS = 128.0


def recordings(spark, sf_dir):
    """512-sample recordings per segment and channel, assembled from at most eight parts each."""
    parts = fixture(spark, sf_dir, "fx_signals")
    packed = F.array_sort(F.collect_list(F.struct("part", "samples")))
    df = parts.groupBy("segment_id", "dataset", "channel").agg(packed.alias("p"))
    return df.select("segment_id", "dataset", "channel", F.flatten(F.transform("p", lambda x: x["samples"])).alias("samples"), L(FS).alias("fs"))


def sample_bounds(spark, sf_dir):
    """S01, S02 over recordings with three window settings."""
    rec = recordings(spark, sf_dir)
    parts = []
    for w, s in ((0.5, 0.25), (1.0, 0.3), (2.51953125, 2.5)):
        b = wd.segment_bounds(rec, F.size("samples"), F.col("fs"), L(w), L(s))
        piece = wd.slice_signal(F.col("samples"), F.col("start"), F.col("end"))
        parts.append(b.select("segment_id", "channel", L(w).alias("window_s"), "window_index", "start", "end", "start_s", "end_s",
                              F.size(piece).alias("n"), F.aggregate(piece, L(0.0), lambda a, x: a + x).alias("total")))
    return finish(reduce(lambda a, b: a.unionByName(b), parts))


def segment_records(spark, sf_dir):
    """S03."""
    c = F.col
    df = wd.segment_record(features(spark, sf_dir), subject_id=c("subject_id"), segment_id=c("segment_id"), dataset=c("dataset"), label=c("label"),
                           source_record_id=c("source_record_id"), window_start_sec=c("window_start_sec"), window_end_sec=c("window_end_sec"),
                           self_report=F.create_map(L("valence"), c("valence"), L("arousal"), c("arousal")))
    return finish(df.select("segment_id", "subject_id", "label", "segment_duration_sec", c("self_report")["valence"].alias("valence"),
                            c("sampling_rates").isNull().alias("no_rates")))


def label_runs(spark, sf_dir):
    """Windows inside kept label runs."""
    return finish(wd.label_run_windows(fixture(spark, sf_dir, "fx_label_track"), 8.0, 2.0, 1.5))


def trimmed(spark, sf_dir):
    """S05."""
    df = fixture(spark, sf_dir, "fx_signals").select(
        "segment_id", "channel", "part", F.col("samples").alias("ecg"), F.slice("samples", L(1), (L(20) + F.col("part") * 5).cast("int")).alias("label_track"))
    df = wd.trim_to_shortest(df, ["ecg", "label_track"])
    return finish(df.select("segment_id", "channel", "part", F.size("ecg").alias("n_ecg"), F.size("label_track").alias("n_label"),
                            F.aggregate("ecg", L(0.0), lambda a, x: a + x).alias("total")))


def _trials(spark, sf_dir):
    t = F.col("trial_id")
    return fixture(spark, sf_dir, "fx_trials").withColumns({
        "dataset": L("deap"), "valence": 1 + (t * 37 % 81) / L(10.0), "arousal": 1 + (t * 53 % 81) / L(10.0), "n": L(512) + t % 5 * 128})


def trial_windows(spark, sf_dir):
    """S06."""
    df = wd.trial_windows(_trials(spark, sf_dir), FS, F.col("n"), 3.0, 1.0, 0.5)
    return finish(df.select("trial_id", "window_index", "start", "end", "window_start_sec", "window_end_sec", "label"))


def dual_rate(spark, sf_dir):
    """EEG clock 128 Hz, ECG clock 250 Hz; baseline and stimulus tables unioned."""
    t = _trials(spark, sf_dir)
    stim = wd.dual_rate_windows(t, F.col("n"), FS, 250.0, 1.0, 0.7).withColumn("phase", L("stimulus"))
    base = wd.dual_rate_windows(t.withColumns({"valence": L(None).cast("double"), "arousal": L(None).cast("double")}), L(256), FS, 250.0, 1.0, 1.0).withColumn("phase", L("baseline"))
    return finish(stim.unionByName(base).select("trial_id", "phase", "window_index", "start", "end", "other_start", "other_end"))


def mean_lead(spark, sf_dir):
    """Mean over the channels per sample."""
    s = fixture(spark, sf_dir, "fx_signals").select("segment_id", (F.col("part") * 64).alias("base"), F.posexplode("samples").alias("o", "v"))
    return finish(wd.mean_lead(s.withColumn("i", F.col("base") + F.col("o")), ["segment_id"]))


def physical_units(spark, sf_dir):
    """S09, S10."""
    v = F.col("value") / 97
    daq = table(spark, sf_dir, "events").select("event_id", v.alias("t_s"), *[v.alias(f"{k}_v") for k in ("ecg", "bvp", "gsr", "resp", "temp")],
                                                wd.joystick_score(F.col("value") * 10 - 2000).alias("joystick"))
    return finish(wd.physical_units(daq).select("event_id", "t_ms", "ecg", "bvp", "gsr", "resp", "temp", "joystick"))


def stimulus_order(spark, sf_dir):
    """Wide order table to ordered stimuli."""
    o = table(spark, sf_dir, "orders")
    wide = o.select(F.col("o_orderkey").alias("place"), F.concat(L(" "), "o_orderpriority").alias("seq_sub1"),
                    F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise(" ").alias("seq_sub2"))
    return finish(wd.stimulus_order(wide, ["seq_sub1", "seq_sub2"]))


_DURATIONS = {"scary-1": 120.5, "amusing-1": 90.25, "boring-1": 200.0, "bluvid": 60.0}


def _durations():
    return F.explode(F.array(*[F.struct(L(k).alias("stimulus"), L(v).alias("duration_s")) for k, v in _DURATIONS.items()]))


def stimulus_offsets(spark, sf_dir):
    """S12, S14."""
    durations = spark.range(1).select(_durations().alias("d")).select("d.*")
    df = wd.stimulus_offsets(fixture(spark, sf_dir, "fx_stimuli"), durations, F.floor(F.col("position") / 4096))
    return finish(df.select("subject_id", "position", "stimulus", "start_s", "label"))


def interval_windows(spark, sf_dir):
    """Windows inside intervals, samples by closed range join, minimum count, mean annotation."""
    trials = fixture(spark, sf_dir, "fx_trials").withColumn("stop", F.col("onset") + F.col("duration"))
    w = wd.interval_windows(trials, "onset", "stop", 240.0, 150.0)
    points = fixture(spark, sf_dir, "fx_aux")
    j = wd.range_join(points, w, ["recording_id"], "t", "window_start_sec", "window_end_sec", 600.0)
    g = j.groupBy("trial_id", "window_index", "window_start_sec").agg(F.count(L(1)).alias("n"), F.avg("v").alias("mean_v"))
    return finish(g.where("n >= 2").withColumn("mean_v", F.col("mean_v") * 1e6))


def target_events(spark, sf_dir):
    """Numeric trials, sample ranges, target centroids."""
    df = wd.target_events(fixture(spark, sf_dir, "fx_trials"), ["recording_id"], ("trial_id",))
    df = wd.event_sample_range(df, L(0.5), L(1290000))
    v, a, name = wd.target_centroid(F.col("trial_type"))
    return finish(df.select("recording_id", "trial_id", "trial_index", "trial_type", "start", "end", v.alias("target_valence"), a.alias("target_arousal"), name.alias("target")))


def event_means(spark, sf_dir):
    """Mean auxiliary value in the event window times 1e6, target centroid as fallback."""
    ev = wd.target_events(fixture(spark, sf_dir, "fx_trials")).withColumn("stop", F.col("onset") + F.col("duration"))
    j = wd.range_join(fixture(spark, sf_dir, "fx_aux"), ev, ["recording_id"], "t", "onset", "stop", 600.0, closed=False)
    means = j.groupBy("trial_id").agg((F.avg("v") * 1e6).alias("aux"))
    v, _, _ = wd.target_centroid(F.col("trial_type"))
    return finish(ev.join(means, "trial_id", "left").select("trial_id", F.coalesce("aux", v).alias("valence"), F.col("aux").isNotNull().alias("measured")))


def path_ids(spark, sf_dir):
    """S19."""
    p = F.col("page_id")
    path = F.concat(L("root/sub-"), F.lpad((p % 40).cast("string"), 2, "0"), L("/ses-"), (p % 3).cast("string"), L("/sub-"), F.lpad((p % 40).cast("string"), 2, "0"),
                    L("_task-run"), (p % 5).cast("string"), L("_eeg.parquet"))
    ids = wd.ids_from_path(path)
    return finish(table(spark, sf_dir, "pages").select("page_id", *[c.alias(n) for n, c in ids.items()]))


def self_report_lookup(spark, sf_dir):
    """Free column names, last duplicate wins."""
    d = F.col("doc_id")
    raw = table(spark, sf_dir, "documents").select(
        d.alias("row_no"), F.concat(L("S"), (d % 17).cast("string")).alias("Subject ID"), F.concat(L(" "), F.upper("lang")).alias("Test-Phase"),
        (1 + d % 9).cast("double").alias("SAM Valence"), (1 + d * 7 % 9).cast("double").alias("SAM Arousal"))
    return finish(wd.self_report_lookup(raw, "row_no"))


def text_labels(spark, sf_dir):
    """S22 over whole texts."""
    return finish(table(spark, sf_dir, "documents").select("doc_id", wd.label_from_text(F.concat_ws(" ", "text", "source")).alias("state")))


def epochs(spark, sf_dir):
    """Epoch rows with the label and phase priority chains."""
    e = F.col("event_id")
    df = table(spark, sf_dir, "events").select(
        "event_id", L("eva_med").alias("dataset"), F.concat(L("stem_"), F.when(e % 4 == 0, "calm").otherwise("mmst")).alias("file_stem"), (e % 50).alias("epoch_index"),
        F.when(e % 3 == 0, "Rest block").otherwise(" ").alias("label"), F.when(e % 2 == 0, F.col("event_type")).otherwise("").alias("event_name"),
        F.when(e % 7 == 0, " Task ").alias("phase"), F.when(e % 5 == 0, 1 + (e % 9) / L(2.0)).alias("valence"), F.when(e % 5 == 0, 1 + (e * 3 % 9) / L(2.0)).alias("arousal"))
    return finish(wd.epoch_segments(df, 4.0).select("event_id", "state", "phase_name", "window_start_sec", "window_end_sec"))


#: Rates of the channels of the cut recordings: two clocks.
_CLOCKS = {"AF3": 128.0, "AF4": 128.0, "F7": 100.0, "F8": 100.0}


def _cut(spark, sf_dir):
    """Sub-windows of all recordings and their signals, joined as pieces of 64 samples."""
    pieces = fixture(spark, sf_dir, "fx_signals").select(
        "segment_id", F.when(F.col("channel").isin("AF3", "AF4"), "eeg").otherwise("ecg").alias("signal"), "channel", fx.by_key(F.col("channel"), _CLOCKS).alias("rate"),
        (F.col("part") * 64).alias("first"), "samples")
    whole = pieces.groupBy("segment_id").agg(F.max((F.col("first") + 64) / F.col("rate")).alias("segment_duration_sec"))
    n = F.regexp_extract("segment_id", "[0-9]+", 0).cast("long")
    segments = whole.withColumns({"parent": F.col("segment_id"), "window_start_sec": n * 10.0, "window_end_sec": L(None).cast("double")})
    windows = wd.expand_segments(segments, 1.5, 0.7).select(F.col("parent").alias("segment_id"), F.col("segment_id").alias("sub_id"), "local_start_sec", "local_end_sec")
    return pc.cut_signals(pieces, windows, ["segment_id"], "sub_id", "local_start_sec", "local_end_sec")


def cut_signals(spark, sf_dir):
    """Every signal of a segment cut to its sub-windows at its own rate."""
    moment = F.aggregate(F.transform("samples", lambda x, i: x * (i + 1)), L(0.0), lambda a, x: a + x)
    return finish(_cut(spark, sf_dir).select(
        "segment_id", "sub_id", "signal", "channel", "start", "end", F.size("samples").alias("n"), F.aggregate("samples", L(0.0), lambda a, x: a + x).alias("total"), moment.alias("moment")))


def trial_signals(spark, sf_dir):
    """Forty channels a trial named by position, windows after the trimmed start, samples of each window."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("v"), "embedding")
    pieces = e.select(F.floor(F.col("v") / 80).alias("trial_id"), F.floor(F.col("v") % 80 / 2).alias("position"), L(32.0).alias("rate"), (F.col("v") % 2 * 64).alias("first"), F.col("embedding").alias("samples"))
    named = pc.deap_signals(pieces)
    t = F.col("trial_id")
    trials = pieces.groupBy("trial_id").agg((F.max("first") + 64).alias("n")).withColumns({"dataset": L("deap"), "valence": 1 + (t * 37 % 81) / L(10.0), "arousal": 1 + (t * 53 % 81) / L(10.0)})
    windows = wd.trial_windows(trials, 32.0, F.col("n"), 3.0, 0.5, 0.25).withColumn("window_index", F.col("window_index").cast("long"))
    cut = pc.cut_signals(named, windows, ["trial_id"], "window_index", "window_start_sec", "window_end_sec").join(windows.select("trial_id", "window_index", "label"), ["trial_id", "window_index"])
    return finish(cut.where("signal <> 'peripheral'").select(
        "trial_id", "window_index", "label", "signal", "channel", "start", "end", F.size("samples").alias("n"), F.aggregate("samples", L(0.0), lambda a, x: a + x).alias("total")))


def fallback(spark, sf_dir):
    """S24."""
    f = fixture(spark, sf_dir, "fx_signals")
    main = f.select("segment_id", "channel", "part", F.when(F.col("part") % 3 != 0, F.element_at("samples", 1)).alias("ecg"))
    other = f.where("part % 2 = 0").select("segment_id", "channel", "part", (F.element_at("samples", 2) * 10).alias("ecg"))
    return finish(wd.with_fallback_signal(main, other, ["segment_id", "channel", "part"]).select("segment_id", "channel", "part", "ecg"))


def expanded(spark, sf_dir):
    """Sub-windows of long segments, duration from the fallback chain, signal slice bounds."""
    e = F.col("segment_id").cast("long")
    df = features(spark, sf_dir).select(
        "segment_id", "window_start_sec", F.when(e % 4 != 0, F.col("window_start_sec") + 3 + e % 20).alias("window_end_sec"),
        F.when(e % 3 == 0, (5 + e % 17).cast("double")).alias("segment_duration_sec"), e.alias("n"))
    df = wd.expand_segments(df, 8.0, 4.0, wd.resolved_duration(F.col("n") % 30 * 100, L(100.0)))
    return finish(df.select("segment_id", "parent_segment_id", "dynamic_window_index", "window_start_sec", "window_end_sec", "segment_duration_sec",
                            wd.half_even(F.col("local_start_sec") * 128).alias("from_sample"), wd.half_even(F.col("local_end_sec") * 128).alias("to_sample")))


def default_windows(spark, sf_dir):
    """Every segment, taken as up to two minutes at 128 Hz, cut by the defaults of its dataset."""
    df = features(spark, sf_dir).select("segment_id", "dataset", ((F.col("segment_id").cast("long") % 120 + 1) * 128).alias("n"))
    parts = []
    for name, dynamic in (("static", False), ("dynamic", True)):
        cut = wd.segment_bounds(df, F.col("n"), L(128.0), *wd.default_windows(F.col("dataset"), dynamic))
        parts.append(cut.groupBy("dataset").agg(F.count(L(1)).alias("windows"), F.countDistinct("segment_id").alias("segments"), F.max("end").alias("last_sample"))
                     .withColumn("regime", L(name)))
    return finish(parts[0].unionByName(parts[1]))


def quarantine(spark, sf_dir):
    """Rows without a usable signal go to the quarantine."""
    df = features(spark, sf_dir)
    good, bad = wd.quarantine(df, F.col("heart_rate").isNotNull() & F.col("eeg_left_power").isNotNull())
    both = good.withColumn("part", L("valid")).unionByName(bad.withColumn("part", L("quarantine")))
    return finish(both.groupBy("part").agg(F.count(L(1)).alias("n")))


def runs(spark, sf_dir):
    """S28."""
    names = table(spark, sf_dir, "events").select(F.concat(L("results_"), "event_type", L("_"), F.when(F.col("event_id") % 3 == 0, "strict").when(F.col("event_id") % 3 == 1, "proxy").otherwise("draft")).alias("name"))
    return finish(wd.discover_runs(names))


def sinks(spark, sf_dir):
    """Scores through the Parquet, CSV and JSON sinks, read back and counted."""
    from tidemark.operators import indices as ix
    from tidemark.sources import sinks as sk

    res = ix.evaluate(features(spark, sf_dir), "V4", "hybrid", sensitivities=False)
    return finish(sk.round_trip_counts(res))


def band_powers(spark, sf_dir):
    """band power per channel."""
    df = sg.channel_powers(recordings(spark, sf_dir))
    return finish(df.select("segment_id", "channel", "side", *[(F.col(b) * 1e3).alias(b) for b in ("full", "alpha", "gamma")]))


def eeg_features(spark, sf_dir):
    """EEG feature block."""
    df = sg.eeg_features(sg.channel_powers(recordings(spark, sf_dir)))
    return finish(df.select("segment_id", *[(F.col(n) * (1e3 if n != "alpha_asymmetry" else 1.0)).alias(n) for n in cfg.EEG_FEATURES], "prov_eeg_gamma_power", "source_eeg_gamma_power"))


def default_channels(spark, sf_dir):
    """names by position where the third channel of a segment has none, with and without a montage."""
    n, at = F.substring("segment_id", 2, 20).cast("long"), F.array_position(F.array(*[L(c) for c in ("AF3", "F7", "AF4", "F8")]), F.col("channel")) - L(1)
    df = recordings(spark, sf_dir).withColumn("position", at).withColumns({
        "channel": F.when((n % 2 == 0) & (F.col("position") == 2), L(None)).otherwise(F.col("channel")),
        "dataset": F.when(n % 5 == 0, "unlisted").otherwise(F.col("dataset"))})
    return finish(sg.channel_powers(df).select("segment_id", "dataset", "position", "channel", "side", (F.col("full") * 1e3).alias("full")))


def _beats(spark, sf_dir):
    b = fixture(spark, sf_dir, "fx_beats").where(F.col("rr").between(*cfg.RR_LIMITS))
    packed = F.array_sort(F.collect_list(F.struct("beat", "rr")))  # at most 64 beats per segment
    return b.groupBy("segment_id").agg(F.transform(packed, lambda x: x["rr"]).alias("rr"))


def rr_features(spark, sf_dir):
    """Interval filter, time-domain and frequency-domain features."""
    return finish(sg.rr_features(_beats(spark, sf_dir)).select("segment_id", *[(F.col(n) * 1e3 if n in ("hrv_hf", "hrv_lf") else F.col(n)).alias(n) for n in cfg.CARDIAC_FEATURES]))


def source_preference(spark, sf_dir):
    """ECG before PPG with provenance."""
    df = features(spark, sf_dir).select("segment_id", *cfg.CARDIAC_FEATURES, (F.col("segment_id").cast("long") % 4).alias("k"))
    ecg = df.where("k <> 0").withColumns({n: F.col(n) for n in cfg.CARDIAC_FEATURES}).withColumn("kind", L("ecg"))
    ppg = df.where("k <> 1").withColumns({n: F.col(n) + 1 for n in cfg.CARDIAC_FEATURES}).withColumn("kind", L("ppg"))
    both = ecg.unionByName(ppg).where(F.coalesce(*cfg.CARDIAC_FEATURES).isNotNull())
    return finish(sg.preferred_source(both).select("segment_id", "heart_rate", "prov_heart_rate", "source_heart_rate"))


def provenance_counts(spark, sf_dir):
    """F16."""
    df = sg.provenance_counts(features(spark, sf_dir))
    return finish(df.select("segment_id", "direct_feature_count", "proxy_feature_count", "unavailable_feature_count", F.col("feature_provenance")["heart_rate"].alias("heart_rate_prov")))


def heart_signals(spark, sf_dir):
    """beats from band-passed heart signals, assembled into the feature table."""
    rec = recordings(spark, sf_dir)
    heart = rec.where("channel in ('AF3', 'F7')").withColumn("kind", F.when(F.col("channel") == "AF3", "ecg").otherwise("ppg"))
    with small_batches(spark):
        eeg = stage(sg.eeg_features(sg.channel_powers(rec)), "eeg")
        cardiac = stage(sg.cardiac_features(heart), "cardiac")
    segs = wd.segment_record(rec.select("segment_id", "dataset").distinct(), segment_id=F.col("segment_id"), dataset=F.col("dataset"), label=L("baseline"))
    return finish(sg.assemble(segs, eeg, cardiac).drop("sampling_rates", "self_report", "metadata", "feature_provenance"))


QUERIES = {
    "s01_s02_segment_bounds": sample_bounds, "s03_segment_record": segment_records, "s04_label_run_windows": label_runs, "s05_trim": trimmed,
    "s06_trial_windows": trial_windows, "s07_dual_rate": dual_rate, "s08_mean_lead": mean_lead, "s09_s10_units": physical_units,
    "s11_stimulus_order": stimulus_order, "s12_s14_stimulus_offsets": stimulus_offsets, "s13_interval_windows": interval_windows,
    "s15_s16_target_events": target_events, "s17_s18_event_means": event_means, "s19_path_ids": path_ids, "s20_self_report_lookup": self_report_lookup,
    "s22_text_labels": text_labels, "s23_epochs": epochs, "s24_fallback_signal": fallback, "s25_s26_expand_segments": expanded, "s25_s07_cut_signals": cut_signals, "s06_trial_signals": trial_signals, "s27_quarantine": quarantine, "s30_default_windows": default_windows,
    "s28_discover_runs": runs, "s29_sinks": sinks, "f01_f02_band_power": band_powers, "f03_f06_eeg_features": eeg_features, "f03_default_channels": default_channels, "f09_f13_rr_features": rr_features,
    "f14_f15_source_preference": source_preference, "f16_provenance_counts": provenance_counts, "f07_f08_f18_heart_features": heart_signals,
}
