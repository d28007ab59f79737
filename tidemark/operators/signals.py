"""Spectral and heart-rhythm features of signal arrays.

Spark partitions the segments; the numeric kernels are short numpy helpers applied to Arrow
batches. Everything around them (channel means, sides, ratios, provenance) stays in the JVM.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import config as cfg
from tidemark.functions import columns as fx

L = F.lit
_POWERS = T.ArrayType(T.DoubleType())
#: Samples that are filtered at once (2 MB a copy), so a worker's copies of them do not grow with the batch.
FILTER_VALUES = 1 << 18


# --- numeric helpers --------------------------------------------------------------------------

def periodogram(x: np.ndarray, fs: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Averaged one-sided density over half-overlapping Hann frames with the mean removed."""
    hop = max(size - size // 2, 1)
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    window = 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(size) / size)
    spectrum = np.fft.rfft((frames - frames.mean(axis=1, keepdims=True)) * window, axis=1)
    density = (spectrum.real**2 + spectrum.imag**2) / (fs * np.sum(window**2))
    density[:, 1 : -1 if size % 2 == 0 else None] *= 2.0
    return np.fft.rfftfreq(size, 1.0 / fs), density.mean(axis=0)


def band_integral(freqs: np.ndarray, power: np.ndarray, band: tuple[float, float]) -> float | None:
    inside = (freqs >= band[0]) & (freqs <= band[1])
    return float(np.trapezoid(power[inside], freqs[inside])) if inside.any() else None


@lru_cache(maxsize=32)
def bandpass_coefficients(fs: float, low: float, high: float) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Third-order Butterworth band-pass by pre-warping, low-pass to band-pass and bilinear transform."""
    order, rate = 3, 2.0
    w1, w2 = (2 * rate * np.tan(np.pi * f / (fs / 2.0) / rate) for f in (low, high))
    width, center = w2 - w1, np.sqrt(w1 * w2)
    proto = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) * width / 2.0
    root = np.sqrt(proto**2 - center**2 + 0j)
    poles = np.concatenate([proto + root, proto - root])
    gain = width**order
    mapped = (2 * rate + poles) / (2 * rate - poles)
    zeros = np.concatenate([np.ones(order), -np.ones(order)])
    scale = gain * np.real((2 * rate) ** order / np.prod(2 * rate - poles))
    return tuple(scale * np.real(np.poly(zeros))), tuple(np.real(np.poly(mapped)))


def _run_filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Direct-form recursion over the time axis for all rows at once."""
    out = np.empty_like(x)
    z = state.copy()
    for i in range(x.shape[1]):
        y = b[0] * x[:, i] + z[:, 0]
        z[:, :-1] = z[:, 1:] + np.outer(x[:, i], b[1:-1]) - np.outer(y, a[1:-1])
        z[:, -1] = b[-1] * x[:, i] - a[-1] * y
        out[:, i] = y
    return out


def zero_phase_bandpass(x: np.ndarray, fs: float, low: float, high: float) -> np.ndarray:
    """Forward-backward band-pass of equally long rows; unchanged when it cannot be applied."""
    if fs <= 0 or low >= high or high >= fs / 2.0:
        return x
    b, a = (np.asarray(c) for c in bandpass_coefficients(fs, low, high))
    pad = 3 * len(a)
    if x.shape[1] <= pad:
        return x
    companion = np.eye(len(a) - 1, k=1)
    companion[:, 0] -= a[1:]
    steady = np.linalg.solve(np.eye(len(a) - 1) - companion, b[1:] - a[1:] * b[0])
    left = 2 * x[:, :1] - x[:, pad:0:-1]
    right = 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]
    y = np.concatenate([left, x, right], axis=1)
    for _ in range(2):
        y = _run_filter(b, a, y, y[:, :1] * steady)[:, ::-1]
    return y[:, pad:-pad]


def peak_positions(x: np.ndarray, distance: int, prominence: float) -> np.ndarray:
    """Local maxima (plateau middles) at least ``distance`` apart, highest first, with enough prominence."""
    edges = np.flatnonzero(np.diff(x) != 0)
    starts, ends = np.concatenate([[0], edges + 1]), np.concatenate([edges, [len(x) - 1]])
    level = x[starts]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    peaks = (starts[top] + ends[top]) // 2
    keep = np.ones(len(peaks), dtype=bool)
    for j in np.argsort(x[peaks], kind="stable")[::-1]:
        if keep[j]:
            near = np.abs(peaks - peaks[j]) < distance
            near[j] = False
            keep[near] = False
    peaks = peaks[keep]
    good = []
    for p in peaks:
        higher = np.flatnonzero(x > x[p])
        before, after = higher[higher < p], higher[higher > p]
        base_left = x[before[-1] if len(before) else 0 : p + 1].min()
        base_right = x[p : (after[0] if len(after) else len(x) - 1) + 1].min()
        if x[p] - max(base_left, base_right) >= prominence:
            good.append(p)
    return np.asarray(good, dtype=int)


def beat_intervals(filtered: np.ndarray, fs: float, kind: str) -> list[float]:
    gap, factor = (0.3, 0.4) if kind == "ecg" else (0.4, 0.25)
    peaks = peak_positions(filtered, int(max(1, gap * fs)), max(float(np.std(filtered)) * factor, cfg.EPSILON))
    if len(peaks) < cfg.MIN_BEATS:
        return []
    rr = np.diff(peaks) / fs
    return rr[(rr >= cfg.RR_LIMITS[0]) & (rr <= cfg.RR_LIMITS[1])].tolist()


def rr_powers(rr: np.ndarray) -> tuple[float | None, float | None]:
    """LF and HF power of beat intervals resampled to 4 Hz without their linear trend."""
    if len(rr) < cfg.MIN_RR_COUNT:
        return None, None
    times = np.cumsum(rr) - rr[0]
    grid = np.arange(0.0, times[-1], 1.0 / cfg.RR_RATE)
    if times[-1] <= 0 or len(grid) < cfg.MIN_RR_SPECTRUM:
        return None, None
    y = np.interp(grid, times, rr)
    slope, level = np.polyfit(grid, y, 1)
    freqs, power = periodogram(y - (slope * grid + level), cfg.RR_RATE, min(len(y), 256))
    return band_integral(freqs, power, cfg.HRV_BANDS["lf"]), band_integral(freqs, power, cfg.HRV_BANDS["hf"])


# --- Arrow UDFs -------------------------------------------------------------------------------

@F.pandas_udf(_POWERS)
def band_powers(samples: pd.Series, fs: pd.Series) -> pd.Series:
    """Power in the full, alpha and gamma bands; NULL entries where the signal is too short."""
    out = []
    for x, rate in zip(samples, fs):
        if x is None or len(x) < cfg.MIN_SIGNAL_SAMPLES or not rate > 0:
            out.append([None] * 3)
            continue
        freqs, power = periodogram(np.asarray(x, dtype=float), rate, min(len(x), int(max(64, rate * 2))))
        out.append([band_integral(freqs, power, cfg.EEG_BANDS[b]) for b in ("full", "alpha", "gamma")])
    return pd.Series(out)


@F.pandas_udf(_POWERS)
def beats(samples: pd.Series, fs: pd.Series, kind: pd.Series) -> pd.Series:
    """Beat intervals of heart signals; rows of equal length, rate and kind are filtered together."""
    out: list[list[float]] = [[] for _ in range(len(samples))]
    groups: dict[tuple, list[int]] = {}
    for i, (x, rate, k) in enumerate(zip(samples, fs, kind)):
        if x is not None and len(x) and rate > 0:
            groups.setdefault((len(x), float(rate), k), []).append(i)
    for (length, rate, k), members in groups.items():
        step = max(1, FILTER_VALUES // length)
        for part in (members[at : at + step] for at in range(0, len(members), step)):
            rows = np.stack([np.asarray(samples.iloc[i], dtype=float) for i in part])
            rows = zero_phase_bandpass(rows, rate, *(cfg.ECG_FILTER if k == "ecg" else cfg.PPG_FILTER))
            for i, row in zip(part, rows):
                out[i] = beat_intervals(row, rate, k)
    return pd.Series(out)


@F.pandas_udf(_POWERS)
def rr_spectrum(rr: pd.Series) -> pd.Series:
    return pd.Series([list(rr_powers(np.asarray(x if x is not None else [], dtype=float))) for x in rr])


# --- feature tables ---------------------------------------------------------------------------

def with_channel_names(powers: DataFrame) -> DataFrame:
    """Channel names of each (segment_id, dataset), whose rows are its channels by 0-based ``position``.

    Names count only if every channel has one. Else the montage of the dataset names them by position, and where it has
    fewer names than there are channels, or there is none, they are EEG_1, EEG_2 and so on.
    """
    segment = Window.partitionBy("segment_id", "dataset")  # a row per channel, samples are gone by now
    montages: dict[str, list[str]] = {}
    for dataset, channel, _, _ in cfg.channel_rows():
        montages.setdefault(dataset, []).append(channel)
    known = F.create_map(*[x for d, names in montages.items() for x in (L(d), F.array(*[L(n) for n in names]))])
    montage, n = F.try_element_at(known, F.lower("dataset")), F.count(L(1)).over(segment)
    default = F.when(F.size(montage) >= n, F.get(montage, F.col("position").cast("int"))).otherwise(
        F.concat(L("EEG_"), (F.col("position") + L(1)).cast("string")))
    return powers.withColumn("channel", F.when(F.count("channel").over(segment) == n, F.col("channel")).otherwise(default))


def channel_powers(signals: DataFrame) -> DataFrame:
    """Band powers per segment and channel with the hemisphere that the dataset's montage gives the channel.

    A channel that the montage lacks, and every channel of a dataset without one, is on no side ("mid"). Where the signals
    carry a ``position``, missing names are given by it.
    """
    at = [c for c in ("position",) if c in signals.columns]
    powers = F.col("_p")
    df = signals.withColumn("_p", band_powers("samples", "fs")).select(
        "segment_id", "dataset", *at, "channel", *[powers[i].alias(b) for i, b in enumerate(("full", "alpha", "gamma"))])
    df = with_channel_names(df) if at else df
    sides = F.create_map(*[L(x) for dataset, channel, _, s in cfg.channel_rows() for x in (f"{dataset}/{channel}", s)])
    side = F.coalesce(F.try_element_at(sides, F.concat_ws("/", F.lower("dataset"), "channel")), L("mid"))
    return df.select("segment_id", "dataset", *at, "channel", side.alias("side"), "full", "alpha", "gamma")


def eeg_features(powers: DataFrame) -> DataFrame:
    """Side means, asymmetry and gamma / alpha ratio; empty unless both sides exist."""
    on = lambda side, band: F.avg(F.when(F.col("side") == side, F.col(band)))
    df = powers.groupBy("segment_id", "dataset").agg(
        on("left", "full").alias("eeg_left_power"), on("right", "full").alias("eeg_right_power"), F.avg("gamma").alias("eeg_gamma_power"),
        on("left", "alpha").alias("eeg_alpha_left"), on("right", "alpha").alias("eeg_alpha_right"),
        F.max((F.col("side") == "left").cast("int")).alias("_l"), F.max((F.col("side") == "right").cast("int")).alias("_r"))
    both = (F.col("_l") == 1) & (F.col("_r") == 1)
    names = ("eeg_left_power", "eeg_right_power", "eeg_gamma_power", "eeg_alpha_left", "eeg_alpha_right")
    df = df.withColumns({n: F.when(both, F.col(n)) for n in names}).drop("_l", "_r")
    e = L(cfg.EPSILON)
    left, right = F.col("eeg_alpha_left"), F.col("eeg_alpha_right")
    df = df.withColumns({
        "alpha_asymmetry": F.ln(right + e) - F.ln(left + e), "gamma_alpha_ratio": F.col("eeg_gamma_power") / (left + right + e)})
    return df.withColumns({f"prov_{n}": F.when(F.col(n).isNotNull(), "direct").otherwise("unavailable") for n in cfg.EEG_FEATURES}
                          | {f"source_{n}": L("eeg") for n in cfg.EEG_FEATURES})


def rr_features(rows: DataFrame, rr: str = "rr") -> DataFrame:
    """Heart-rate features of an interval array: rmssd, sdnn, rate (JVM) and LF / HF (Arrow)."""
    n = F.size(rr)
    df = rows.withColumn(rr, F.when(n >= cfg.MIN_RR_COUNT, F.col(rr)))
    x = F.col(rr)
    steps = F.zip_with(F.slice(x, L(2), F.size(x) - L(1)), F.slice(x, L(1), F.size(x) - L(1)), lambda b, a: (b - a) * (b - a))
    df = df.withColumns({"_mean": fx.array_mean(x), "_sq": fx.array_mean(steps), "_p": rr_spectrum(x)})
    spread = F.aggregate(x, L(0.0), lambda acc, v: acc + (v - F.col("_mean")) * (v - F.col("_mean")))
    lf, hf, e = F.col("_p")[0], F.col("_p")[1], L(cfg.EPSILON)
    return df.withColumns({
        "hrv_hf": hf, "hrv_lf": lf, "hrv_hf_lf": hf / (lf + e), "hrv_lf_hf": lf / (hf + e),
        "heart_rate": F.when(F.col("_mean") > 0, L(60.0) / F.col("_mean")),
        "hrv_rmssd": F.sqrt("_sq") * L(1000.0), "hrv_sdnn": F.sqrt(spread / (F.size(x) - L(1))) * L(1000.0),
    }).drop("_mean", "_sq", "_p")


def cardiac_features(signals: DataFrame) -> DataFrame:
    """Features per segment from ECG when any is finite (direct), else from PPG (proxy)."""
    heart = signals.where(F.col("kind").isin("ecg", "ppg")).withColumn("rr", beats("samples", "fs", "kind"))
    rows = rr_features(heart.select("segment_id", "kind", "rr"))
    finite = F.coalesce(*[F.col(n) for n in cfg.CARDIAC_FEATURES]).isNotNull()
    return preferred_source(rows.where(finite))


def preferred_source(rows: DataFrame) -> DataFrame:
    """One row per segment by source priority with provenance and source columns."""
    packed = F.struct(*cfg.CARDIAC_FEATURES, "kind")
    best = rows.groupBy("segment_id").agg(F.min_by(packed, F.when(F.col("kind") == "ecg", 0).otherwise(1)).alias("_b")).select("segment_id", "_b.*")
    prov = F.when(F.col("kind") == "ecg", "direct").otherwise("proxy")
    cols = {}
    for n in cfg.CARDIAC_FEATURES:
        cols[f"prov_{n}"] = F.when(F.col(n).isNotNull(), prov).otherwise("unavailable")
        cols[f"source_{n}"] = F.when(F.col(n).isNotNull(), F.col("kind")).otherwise("")
    return best.withColumns(cols).drop("kind")


def provenance_counts(features: DataFrame) -> DataFrame:
    """Counts of direct / proxy / unavailable features per row, and the provenance map."""
    names = [c for c in features.columns if c.startswith("prov_")]
    arr = F.array(*[F.col(c) for c in names])
    count = lambda kind: F.size(F.filter(arr, lambda x: x == kind))
    return features.withColumns({
        "direct_feature_count": count("direct"), "proxy_feature_count": count("proxy"), "unavailable_feature_count": count("unavailable"),
        "feature_provenance": F.map_from_arrays(F.array(*[L(c[5:]) for c in names]), arr)})


def assemble(segments: DataFrame, eeg: DataFrame, cardiac: DataFrame) -> DataFrame:
    """Feature table: segments, self-report, stress load, EEG and cardiac blocks."""
    report = {n: fx.finite(F.col("self_report")[n]) for n in ("valence", "arousal", "dominance", "liking")}
    df = segments.withColumns(report)
    load, prov, source = fx.stress_encoding(F.col("dataset"), F.col("label"), F.col("valence"), F.col("arousal"))
    df = df.withColumns({"stress_label": load, "prov_stress_label": prov, "source_stress_label": source})
    df = df.join(eeg.drop("dataset"), "segment_id", "left").join(cardiac, "segment_id", "left")
    blank = {f"prov_{n}": F.coalesce(f"prov_{n}", L("unavailable")) for n in (*cfg.EEG_FEATURES, *cfg.CARDIAC_FEATURES)}
    blank |= {f"source_{n}": F.coalesce(f"source_{n}", L("eeg")) for n in cfg.EEG_FEATURES}
    blank |= {f"source_{n}": F.coalesce(f"source_{n}", L("")) for n in cfg.CARDIAC_FEATURES}
    return provenance_counts(df.withColumns(blank))


