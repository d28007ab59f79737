"""Streams that read several files, one per trigger, against the batch result over all rows."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.streaming import causal as st


def test_label_runs_over_three_files(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, "A", 0), (1, "B", 60), (1, "A", 120), (1, "A", 180), (2, "A", 0), (2, "A", 100_000), (1, "A", 90_000), (2, "B", 100_060), (3, "C", 500_000)]
    for k in range(3):
        part = [(u, x, start + dt.timedelta(seconds=s)) for u, x, s in rows[3 * k : 3 * k + 3]]
        spark.createDataFrame(part, "user_id long, event_type string, event_time timestamp").coalesce(1).write.parquet(f"{tmp_path}/f{k}")
    folder = tmp_path / "all"
    folder.mkdir()
    for k in range(3):
        next((tmp_path / f"f{k}").glob("part-*.parquet")).rename(folder / f"{k}.parquet")
    stream = st.read_stream(spark, str(folder), max_files=1)
    out = st.run_available(st.label_sessions(stream, "1 hours", "2 days"), "runs")
    got = sorted((r.user_id, r.event_type, int((r.session_start - start).total_seconds()), int((r.session_end - start).total_seconds()), r.n) for r in out.collect())
    assert got == [(1, "A", 0, 60, 1), (1, "A", 120, 3780, 2), (1, "A", 90_000, 93_600, 1), (1, "B", 60, 120, 1), (2, "A", 0, 3600, 1), (2, "A", 100_000, 100_060, 1), (2, "B", 100_060, 103_660, 1)]


def test_preview_covers_all_rows_so_far(spark, tmp_path):
    from tidemark.operators import indices as ix
    from tidemark.sources import tables

    feats = tables.fixture(spark, "/root/testdata/sf0.001", "fx_features")
    scored = ix.evaluate(feats, "V4", "hybrid", sensitivities=False).withColumn("part", F.pmod(F.hash("segment_id"), F.lit(3)))
    folder = tmp_path / "all"
    scored.repartition(1).write.partitionBy("part").parquet(str(tmp_path / "parts"))
    folder.mkdir()
    for k in range(3):
        next((tmp_path / "parts" / f"part={k}").glob("*.parquet")).rename(folder / f"{k}.parquet")
    counts = []
    st.live_preview(st.read_stream(spark, str(folder), max_files=1), lambda df, epoch: counts.append(df.count())).awaitTermination()
    total = scored.count()
    assert len(counts) == 3 and counts == sorted(counts) and counts[0] < counts[1] < counts[2] <= total
