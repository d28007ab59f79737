"""Structured Streaming forms of the causal operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark import config as cfg
from tidemark.operators import dynamics as dy
from tidemark.operators.resource import preview_map
from tidemark.session import shared_folder

D = cfg.DYNAMICS


def read_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", max_files: int = 64) -> DataFrame:
    """File stream over the Parquet files of a folder that match ``pattern``; bounded files per trigger."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", pattern).parquet(folder)
    )


def windowed_features(events: DataFrame, length: str, step: str, delay: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding window counts and means per key behind a watermark."""
    df = events.withWatermark("event_time", delay)
    grouped = df.groupBy(F.window("event_time", length, step), "event_type")
    out = grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "n", "mean_value", "max_value")


_RUN = "start_us long, end_us long, user_id long, event_type string, n long"
_RUN_STATE = "label string, start long, last long, n long, pending_us array<long>, pending array<string>"


def _session_update(gap_us: int):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        label, start, last, n, times, labels = state.get if state.exists else (None, 0, 0, 0, [], [])
        watermark = state.getCurrentWatermarkMs() * 1000
        pending = list(zip(times, labels))
        if not state.hasTimedOut:
            for frame in batches:
                pending.extend((int(t), x) for t, x in zip(frame["time_us"], frame["event_type"]) if t > watermark)
        pending.sort(key=lambda p: (p[0], p[1] is not None, p[1] or ""))
        due = [p for p in pending if p[0] <= watermark]
        pending = pending[len(due):]
        out = []
        for t, x in due:
            if n and (x != label or t >= last + gap_us):
                out.append((start, min(last + gap_us, t), key[0], label, n))
                n = 0
            if not n:
                label, start = x, t
            last, n = t, n + 1
        if n and last + gap_us <= watermark:
            out.append((start, last + gap_us, key[0], label, n))
            n = 0
        if n or pending:
            state.update((label, start, last, n, [p[0] for p in pending], [p[1] for p in pending]))
            wake = min([p[0] for p in pending[:1]] + [last + gap_us] * bool(n))
            state.setTimeoutTimestamp(max(wake // 1000, watermark // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _RUN.split(", ")])

    return update


def label_sessions(events: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Runs of one label per user: another label or a gap in time ends a run.

    Rows wait for the watermark and are taken in (time, label) order. A run is emitted once the row that ends it, or
    the gap after its last row, is behind the watermark; its end is the earlier of both. Finished users leave no state.
    """
    gap_us = pd.Timedelta(gap) // pd.Timedelta(microseconds=1)
    rows = events.withWatermark("event_time", delay).select("user_id", "event_type", "event_time", F.unix_micros("event_time").alias("time_us"))
    runs = rows.groupBy("user_id").applyInPandasWithState(_session_update(int(gap_us)), _RUN, _RUN_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return runs.select(F.timestamp_micros("start_us").alias("session_start"), F.timestamp_micros("end_us").alias("session_end"), "user_id", "event_type", "n")


OUTPUT_SCHEMA = "dataset string, mode string, version string, source_key string, segment_id string, time_ms long, score double, score_fast double, score_smooth_core double, dynamic_mode string, score_dynamic double"
STATE_SCHEMA = (
    "ewma_fast double, dynamic double, recent array<double>, steps array<double>, "
    "pending_ms array<long>, pending_id array<string>, pending array<array<double>>"
)
_VALUES = ["score", "Gamma", "V", "Q"]


def _median(values: list[float]) -> float:
    ordered, n = sorted(values), len(values)
    return (ordered[(n - 1) // 2] + ordered[n // 2]) / 2.0


def _clip(x: float, low: float, high: float) -> float:
    return min(max(x, low), high)


def _advance(fast: float, dynamic: float, recent: list[float], steps: list[float], row: list[float]):
    """One row through the trailing frames and the recurrences."""
    score = row[0]
    gamma, v, q = (0.0 if x is None or x != x else x for x in row[1:])
    steps = (steps + [abs(score - recent[-1]) if recent else 0.0])[-D["volatility_frame"]:]
    recent = (recent + [score])[-D["frame"]:]
    fast = dy.ewma_step(fast, score, D["fast_alpha"])
    core = D["blend"] * fast + (1.0 - D["blend"]) * _median(recent)
    ratio = sum(steps) / len(steps) / D["volatility_scale"]
    weight, vn = _clip(ratio, D["weight_min"], D["weight_max"]), _clip(ratio, 0.0, 1.0)
    drive = 0.45 * _clip((gamma + 1) / 2, 0, 1) + 0.35 * _clip((1 - v) / 2, 0, 1) + 0.20 * _clip((1 - q) / 2, 0, 1)
    response = _clip(D["response_base"] + D["response_scale"] * drive + D["response_volatility"] * vn, D["gain_min"], D["gain_max"])
    recovery = _clip(D["recovery_base"] + D["recovery_scale"] * (1 - drive) + D["recovery_volatility"] * vn, D["gain_min"], D["gain_max"])
    dynamic, mode = dy.asymmetric_step(dynamic, score, core, weight, response, recovery)
    return fast, dynamic, recent, steps, core, mode


def update_record(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Buffers rows until the watermark passes them, then folds them in (time, id) order.

    Rows inside the allowed delay are therefore put in order; rows behind the watermark are
    rejected by the engine's watermark filter upstream or here.
    """
    nan = float("nan")
    fast, dynamic, recent, steps, ms, ids, values = state.get if state.exists else (nan, nan, [], [], [], [], [])
    fast, dynamic = (nan if x is None else x for x in (fast, dynamic))
    pending = [(t, i, list(v)) for t, i, v in zip(ms, ids, values)]
    watermark = state.getCurrentWatermarkMs()
    if not state.hasTimedOut:
        for frame in batches:
            rows = zip(frame["time_ms"], frame["segment_id"], frame[_VALUES].to_numpy(dtype=float).tolist())
            pending.extend((int(t), i, v) for t, i, v in rows if t > watermark)
    pending.sort(key=lambda r: (r[0], r[1]))
    out = []
    ready = sum(r[0] <= watermark for r in pending)
    due, pending = pending[:ready], pending[ready:]
    for t, i, row in due:
        fast, dynamic, recent, steps, core, mode = _advance(fast, dynamic, list(recent), list(steps), row)
        out.append((*key, i, t, row[0], fast, core, mode, dynamic))
    state.update((fast, dynamic, list(recent), list(steps), [p[0] for p in pending], [p[1] for p in pending], [p[2] for p in pending]))
    if pending:
        state.setTimeoutTimestamp(max(pending[0][0], watermark + 1))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT_SCHEMA.split(", ")])


def causal_stream(scores: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Stateful causal update per record over a stream of scores with an ``event_time`` column."""
    df = dy.prepare(scores).withColumn("time_ms", F.floor(F.col("window_start_sec") * 1000).cast("long"))
    rows = df.select(*dy.RECORD_KEYS, "segment_id", "time_ms", "event_time", *_VALUES).withWatermark("event_time", delay)
    return rows.groupBy(*dy.RECORD_KEYS).applyInPandasWithState(
        update_record, OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over everything available into a Parquet table in the shared folder and reads it back."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def live_preview(scores: DataFrame, sink: Callable[[DataFrame, int], None]) -> object:
    """After each micro-batch: the resource map over all rows seen so far, handed to ``sink``.

    Each batch is added to a running table in the shared folder under its epoch, so a repeated batch replaces itself.
    """
    folder = f"{shared_folder(scores.sparkSession)}/preview-{uuid.uuid4().hex}"

    def each(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")
        sink(preview_map(batch.sparkSession.read.parquet(f"{folder}/rows").where(F.col("epoch") <= epoch).drop("epoch")), epoch)

    return scores.writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(each).trigger(availableNow=True).start()
