"""Sequence results do not depend on chunk sizes, gaps at chunk borders, or other datasets with the same ids."""

import math

from pyspark.sql import functions as F

from tidemark.operators import dynamics as dy
from tidemark.operators import search as se
from tidemark.operators import signals, whatif, windows


def scores(spark, n, gap=range(0), datasets=("d1",)):
    df = spark.range(n).crossJoin(spark.createDataFrame([(d,) for d in datasets], "dataset string"))
    wave = lambda k: (F.col("id") * k % 97) / 97.0
    res = F.when(~F.col("id").between(gap.start, gap.stop - 1) | F.lit(not len(gap)), wave(31))
    return df.select(
        "dataset", F.lit("hybrid").alias("mode"), F.lit("V4").alias("version"), F.lit("rec").alias("source_record_id"), F.lit("u").alias("subject_id"),
        F.format_string("s%06d", "id").alias("segment_id"), (F.col("id") * 10.0).alias("window_start_sec"), wave(17).alias("score"),
        wave(13).alias("A"), wave(11).alias("Gamma"), wave(7).alias("V"), wave(5).alias("Q"), res.alias("RES"))


def test_dynamics_with_long_gaps_at_chunk_borders(spark):
    df = dy.prepare(scores(spark, 2600, range(150, 1900)))
    one = {r.segment_id: r for r in dy.dynamic_frame(df, chunk_rows=100_000).collect()}
    y, w = math.nan, 1.0
    for r in df.orderBy("window_start_sec").collect():
        y, w = dy.gapped_ewma_step((y, w), math.nan if r.RES is None else r.RES, dy.D["resource_alpha"])
        assert (one[r.segment_id].RES_fast is None) == (y != y) and (y != y or abs(one[r.segment_id].RES_fast - y) < 1e-12)
    for chunk_rows in (1000, 777, 1300):
        for r in dy.dynamic_frame(df, chunk_rows=chunk_rows).collect():
            want = one[r.segment_id]
            assert (r.RES_fast is None) == (want.RES_fast is None) and (r.RES_fast is None or abs(r.RES_fast - want.RES_fast) < 1e-12)
            assert abs(r.score_dynamic - want.score_dynamic) < 1e-9 and r.dynamic_mode == want.dynamic_mode


def test_label_runs_with_missing_samples(spark):
    track = spark.range(200).where("id not in (15, 16, 31, 64)").select(F.lit("r").alias("recording_id"), F.col("id").alias("i"), F.when(F.col("id") < 120, 1).when(F.col("id") < 130, 2).otherwise(1).alias("label_code"))
    want = [(1, 0, 120), (2, 120, 130), (1, 130, 200)]
    for chunk_rows in (16, 50, 100_000):
        got = sorted((tuple(r) for r in windows.label_runs(track, chunk_rows=chunk_rows).select("label_code", "run_start", "run_end").collect()), key=lambda r: r[1])
        assert got == want


def test_two_datasets_with_the_same_ids(spark):
    df = scores(spark, 300, datasets=("d1", "d2"))
    out = whatif.perturb_component(df, "V4", "A", 0.5, start=500.0, end=900.0)
    assert out.count() == 600


def test_channels_by_dataset(spark):
    signal = [math.sin(i / 3) for i in range(512)]
    rows = [("a", "dreamer", c, signal, 128.0) for c in ("AF3", "AF4", "C3")] + [("b", "wesad", c, signal, 128.0) for c in ("AF3", "AF4")]
    df = spark.createDataFrame(rows, "segment_id string, dataset string, channel string, samples array<double>, fs double")
    sides = {(r.dataset, r.channel): r.side for r in signals.channel_powers(df).collect()}
    assert sides == {("dreamer", "AF3"): "left", ("dreamer", "AF4"): "right", ("dreamer", "C3"): "mid", ("wesad", "AF3"): "mid", ("wesad", "AF4"): "mid"}
    blocks = {r.dataset: r.eeg_left_power for r in signals.eeg_features(signals.channel_powers(df)).collect()}
    assert blocks["wesad"] is None and blocks["dreamer"] is not None


def test_folds_follow_the_order_of_ids(spark):
    ids = ["Aɐx", "Bz", "Ca", "Zed", "Ж 1"] + [f"U{i:03d}" for i in range(40)]
    got = {r.subject_id: r.fold for r in se.subject_folds(spark.createDataFrame([(i,) for i in ids], "subject_id string"), 4).collect()}
    assert got == {s: i % 4 for i, s in enumerate(sorted(ids, key=str.encode))}


def test_quantiles_and_ranks_with_outliers_and_null_groups(spark):
    import numpy as np
    from scipy_free_ranks import average_ranks as plain_ranks

    from tidemark.operators import ordered as od

    rng = np.random.default_rng(3)
    groups = {"out": [*rng.random(3000), 1e8, -1e12], "tight": [*(rng.random(800) * 1e-9), *(1 + rng.random(800) * 1e-9)], None: [3.0, 1.0, 2.0], "same": [5.0] * 50, "one": [7.0]}
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [("one", None)], "g string, x double")
    got = {r.g: (r.a, r.b) for r in od.exact_quantiles(df, ["g"], "x", {"a": 0.5, "b": 0.95}).collect()}
    for g, xs in groups.items():
        assert np.allclose(got[g], np.quantile(xs, [0.5, 0.95]), rtol=1e-12, atol=0)
    rows, _ = od.value_bins(df, ["g"], "x", 4096)
    assert rows.where("g in ('out', 'tight')").groupBy("g", "_bin").count().agg(F.max("count")).first()[0] <= 110
    ranks = {(r.g, r.x): r["rank"] for r in od.average_ranks(df.withColumn("m", F.lit(1)), ["g"], ["m"], "x").collect()}
    for g, xs in groups.items():
        for x, rank in plain_ranks(xs).items():
            assert ranks[g, x] == rank


def test_windows_need_samples(spark):
    intervals = spark.createDataFrame([("r", 0.0, 10.0)], "key string, a double, b double")
    out = windows.interval_windows(intervals, "a", "b", 2.0, 1.0)
    samples = spark.range(900).select(F.lit("r").alias("key"), F.when(F.col("id") < 600, F.col("id") / 150.0).otherwise(6 + (F.col("id") - 600) / 150.0).alias("t"))
    kept = sorted(r.window_index for r in windows.enough_samples(out, samples, ["key"], "t", 5.0, 256).collect())
    times = [i / 150 if i < 600 else 6 + (i - 600) / 150 for i in range(900)]
    assert kept == [k for k in range(9) if sum(k <= t <= k + 2 for t in times) >= 256]
