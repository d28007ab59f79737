"""Signals cut along windows from pieces, against slices of whole recordings."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.operators import pieces as pc
from tidemark.operators import signals as sg
from tidemark.operators import windows as wd

RATES = {"eeg": 128.0, "ecg": 250.0, "gsr": 4.0}
PIECES = "rec string, signal string, channel string, rate double, first long, samples array<double>"
WINDOWS = "rec string, w long, a double, b double"


def _recordings():
    rng = random.Random(3)
    out = {}
    for rec, seconds in (("hot", 40.0), ("cold", 2.5), (None, 3.0)):
        for signal, rate in RATES.items():
            out[rec, signal] = [rng.uniform(-1, 1) for _ in range(int(seconds * rate))]
    return out


def _pieces(recordings, length):
    rng = random.Random(4)
    rows = []
    for (rec, signal), values in recordings.items():
        at = 0
        while at < len(values):
            n = max(1, int(length * rng.uniform(0.3, 1)))
            rows.append((rec, signal, "c" if signal == "eeg" else None, RATES[signal], at, values[at : at + n]))
            at += n
    return rows


def _windows():
    rng = random.Random(5)
    rows = [(rec, i, i * 0.7, i * 0.7 + 1.0) for rec, n in (("hot", 55), ("cold", 4), (None, 3), ("none", 2)) for i in range(n)]
    rows += [("hot", 100 + i, a, a + rng.uniform(0, 3)) for i, a in enumerate(rng.uniform(0, 40) for _ in range(20))]
    return [*rows, ("hot", 200, None, None), ("hot", 201, -1.0, 0.5), ("hot", 202, 2.0, 1.0), ("hot", 203, 50.0, 51.0), ("cold", 204, 1.0, None)]


@pytest.mark.parametrize(("length", "slot"), [(7, 16), (100, 64), (10_000, 33), (10_000, pc.SLOT)])
def test_any_pieces_and_slots_give_the_slices(spark, length, slot):
    recordings, asked = _recordings(), _windows()
    got = pc.cut_signals(spark.createDataFrame(_pieces(recordings, length), PIECES), spark.createDataFrame(asked, WINDOWS), ["rec"], "w", "a", "b", slot).collect()
    want = {}
    for rec, w, a, b in asked:
        for signal, rate in RATES.items():
            if (rec, signal) in recordings:
                values = recordings[rec, signal]
                start = max(round((a or 0.0) * rate), 0)
                end = max(len(values), start) if b is None else max(round(b * rate), start)
                want[rec, w, signal] = (start, end, values[start:end])
    assert len(got) == len(want)
    assert {(r.rec, r.w, r.signal): (r.start, r.end, list(r.samples)) for r in got} == want


def test_odd_pieces(spark):
    rows = [("a", "eeg", "c", None, 0, [1.0, 2.0]), ("a", "ecg", "c", 0.0, 0, [1.0]), ("a", "gsr", "c", 2.0, 0, []), ("a", "ppg", "c", 2.0, 0, [1.0, None, 3.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], PIECES + ", w string")
    windows = spark.createDataFrame([("a", 1, 0.0, 1.5, "y")], WINDOWS + ", samples string")
    got = {r.signal: (r.start, r.end, r.samples) for r in pc.cut_signals(df, windows, ["rec"], "w", "a", "b").collect()}
    assert got == {"eeg": (None, None, None), "ecg": (None, None, None), "gsr": (0, 3, []), "ppg": (0, 3, [1.0, None, 3.0])}
    assert pc.cut_signals(df.where("false"), windows, ["rec"], "w", "a", "b").count() == 0 == pc.cut_signals(df, windows.where("false"), ["rec"], "w", "a", "b").count()


def test_features_of_sub_windows_at_two_rates(spark):
    """Band powers and beats of expanded segments are those of the samples cut by hand."""
    t = {s: np.arange(int(30 * RATES[s])) / RATES[s] for s in ("eeg", "ecg")}
    whole = {("r", "eeg"): (np.sin(2 * math.pi * 10 * t["eeg"]) + 0.3 * np.sin(2 * math.pi * 35 * t["eeg"])).tolist(), ("r", "ecg"): (np.exp(-((t["ecg"] % 0.8 - 0.4) ** 2) / 0.0008)).tolist()}
    segments = spark.createDataFrame([("r", "r", 5.0, 35.0, 30.0)], "rec string, segment_id string, window_start_sec double, window_end_sec double, segment_duration_sec double")
    windows = wd.expand_segments(segments, 10.0, 5.0)
    cut = pc.cut_signals(spark.createDataFrame(_pieces(whole, 500), PIECES), windows, ["rec"], "segment_id", "local_start_sec", "local_end_sec", 1000)
    powers = cut.withColumn("p", sg.band_powers("samples", F.col("rate"))).where("signal = 'eeg'").collect()
    beats = cut.withColumn("p", sg.beats("samples", F.col("rate"), F.lit("ecg"))).where("signal = 'ecg'").collect()
    assert [len(x) for x in (powers, beats)] == [5, 5] and {r.end - r.start for r in powers} == {1280} and {r.end - r.start for r in beats} == {2500}
    for r in powers:
        x = np.array(whole["r", "eeg"][r.start : r.end])
        freqs, power = sg.periodogram(x, 128.0, 256)
        assert r.p == pytest.approx([sg.band_integral(freqs, power, cfg.EEG_BANDS[b]) for b in ("full", "alpha", "gamma")])
    for r in beats:
        filtered = sg.zero_phase_bandpass(np.array([whole["r", "ecg"][r.start : r.end]]), 250.0, *cfg.ECG_FILTER)
        assert len(r.p) > 5 and r.p == pytest.approx(list(sg.beat_intervals(filtered[0], 250.0, "ecg")))


def test_channel_positions(spark):
    df = spark.range(-1, 41).selectExpr("id as position", "'x' as channel", "1.5 as v").unionByName(spark.sql("select cast(null as long) as position, 'x' as channel, 1.5 as v"))
    got = {r.position: (r.signal, r.channel) for r in pc.deap_signals(df).collect()}
    assert sorted(got) == list(range(40)) and all(got[i] == ("eeg", c) for i, c in enumerate(cfg.DEAP_CHANNELS))
    assert [got[i][0] for i in range(32, 40)] == ["peripheral"] * 4 + ["gsr", "respiration", "ppg", "temperature"] and got[36][1] == "GSR"
