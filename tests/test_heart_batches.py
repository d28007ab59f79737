"""Memory of the heart features: signals are filtered in parts of bounded size, in batches of bounded size."""

import numpy as np
import pandas as pd

from tidemark.operators import signals as sg
from tidemark.plans import windowing
from tidemark.session import BATCH_BYTES, small_batches

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_filter_takes_parts_of_a_batch(monkeypatch):
    rows = pd.Series(list(np.random.default_rng(3).standard_normal((1500, 512))))
    rates, kinds = pd.Series([128.0] * 1500), pd.Series(["ecg", "ppg"] * 750)
    sizes, plain = [], sg.zero_phase_bandpass
    monkeypatch.setattr(sg, "zero_phase_bandpass", lambda x, *a: (sizes.append(x.size), plain(x, *a))[1])
    got = sg.beats.func(rows, rates, kinds)
    assert max(sizes) <= 1 << 18 and sum(sizes) == 1500 * 512
    alone = [sg.beats.func(rows[i : i + 1], rates[i : i + 1], kinds[i : i + 1]).iloc[0] for i in range(0, 1500, 97)]
    assert [got[i] for i in range(0, 1500, 97)] == alone


def test_heart_features_run_in_small_batches(spark, monkeypatch):
    seen, plain, before = {}, windowing.stage, spark.conf.get(NAME)
    monkeypatch.setattr(windowing, "stage", lambda df, name: (seen.update({name: spark.conf.get(NAME)}), plain(df, name))[1])
    windowing.heart_signals(spark, "/root/testdata/sf0.001")
    assert seen["cardiac"] == seen["eeg"] == str(BATCH_BYTES) and spark.conf.get(NAME) == before


def test_setting_is_put_back_after_an_error(spark):
    before = spark.conf.get(NAME)
    try:
        with small_batches(spark):
            raise ValueError
    except ValueError:
        assert spark.conf.get(NAME) == before
