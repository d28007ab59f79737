"""Registered queries: streaming forms and clustering evidence."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import batched
from tidemark.operators import clusters as cl
from tidemark.operators import indices as ix
from tidemark.plans.mapping import SPACE as MEASURED
from tidemark.plans.mapping import results
from tidemark.plans.output import finish
from tidemark.plans.staging import stage
from tidemark.session import shared_folder
from tidemark.sources import fixture_sql
from tidemark.sources.tables import table
from tidemark.streaming import causal as st

L = F.lit


def _events(spark, sf_dir):
    return st.read_stream(spark, sf_dir, "events.parquet").withColumn("event_time", F.col("ts").cast("timestamp"))


def _seconds(c: str):
    return F.unix_micros(F.col(c)) / 1e6 - F.unix_micros(F.to_timestamp(L("2024-01-01 00:00:00"))) / 1e6


def window_stream(spark, sf_dir):
    """Sliding windows closed by the watermark."""
    out = st.run_available(st.windowed_features(_events(spark, sf_dir), "6 hours", "3 hours"), "windows")
    return finish(out.select(_seconds("window_start").alias("start_s"), _seconds("window_end").alias("end_s"), "event_type", "n", "mean_value", "max_value"))


def session_stream(spark, sf_dir):
    """Label runs per user that the watermark has closed."""
    out = st.run_available(st.label_sessions(_events(spark, sf_dir), "12 hours"), "sessions")
    return finish(out.select(_seconds("session_start").alias("start_s"), _seconds("session_end").alias("end_s"), "user_id", "event_type", "n"))


def _scores(spark, sf_dir):
    events = _events(spark, sf_dir)
    body, _ = fixture_sql.spark_view("fx_features")
    feats = spark.sql(body, events=events)
    scored = ix.evaluate(feats, "V4", "hybrid", sensitivities=False)
    return scored.withColumn("event_time", F.timestamp_micros((F.col("window_start_sec") * 1e6).cast("long")))


def causal_stream(spark, sf_dir):
    """Stateful causal update; rows wait for the watermark and are folded in order."""
    out = st.run_available(st.causal_stream(_scores(spark, sf_dir)), "causal")
    return finish(out.drop("time_ms", "dataset", "mode", "version"))


def preview(spark, sf_dir):
    """Resource map over all rows, as it stands after the last micro-batch."""
    folder = f"{shared_folder(spark)}/preview-out-{uuid.uuid4().hex}"
    query = st.live_preview(_scores(spark, sf_dir), lambda df, epoch: df.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}"))
    query.awaitTermination()
    maps = spark.read.parquet(folder)
    last = maps.agg(F.max("epoch")).first()[0]
    return finish(maps.where(F.col("epoch") == last).groupBy("state_map_4").agg(F.count(L(1)).alias("n")))


# --- clustering evidence ------------------------------------------------------------------------

SPACE = ["score", "Q", "A", "Gamma", "V"]


def _clustered(spark, sf_dir):
    df = results(spark, sf_dir, "hybrid", ("V4",), columns=MEASURED)
    scaled = stage(cl.robust_scale(df.where("score is not null"), SPACE), "scaled")
    return scaled.withColumn("cluster", F.when(F.col("s_A") + F.col("s_V") > 1, 2).when(F.col("s_Gamma") > 0, 1).otherwise(0))


def robust_scaling(spark, sf_dir):
    """K13."""
    return finish(_clustered(spark, sf_dir).select("segment_id", *[f"s_{m}" for m in SPACE]))


def internal_indices(spark, sf_dir):
    """K16 for a given assignment."""
    return finish(cl.internal_indices(_clustered(spark, sf_dir), [f"s_{m}" for m in SPACE], "cluster", ["version"]))


def agreement(spark, sf_dir):
    """K17 against the labels."""
    return finish(cl.agreement(_clustered(spark, sf_dir), "label", "cluster", ["version"]))


def quadrants(spark, sf_dir):
    """K18."""
    return finish(cl.va_quadrant(results(spark, sf_dir, "hybrid", ("V4",))).select("segment_id", "va_quadrant"))


def shares(spark, sf_dir):
    """K19."""
    return finish(cl.cluster_shares(_clustered(spark, sf_dir), "cluster", ["version"]))


def _candidate_table(spark, sf_dir):
    """Candidate metrics derived from the events, one row per pseudo version, algorithm and k."""
    e = table(spark, sf_dir, "events")
    u = F.col("user_id")
    x = F.avg("value")
    return e.groupBy(
        F.concat(L("V"), (u % 3).cast("string")).alias("version"), F.when(F.floor(u / 3) % 2 == 0, "kmeans").otherwise("gmm").alias("algorithm"), (2 + F.floor(u / 6) % 4).cast("int").alias("k")
    ).agg(
        (x / 100 - 0.1).alias("silhouette_score"), (F.stddev_samp("value") / 50).alias("davies_bouldin_index"), F.sum("value").alias("calinski_harabasz_score"),
        (F.min("value") % 1).alias("label_ari"), (F.max("value") % 1).alias("label_nmi"), ((F.max("value") * 7) % 1).alias("va_ari"),
        ((F.sum("value") * 3) % 1).alias("va_nmi"), (0.4 + (F.sum("value") % 1) / 2).alias("bootstrap_mean_ari"), ((F.sum("value") * 11) % 1 / 2).alias("tiny_cluster_rate"))


def candidate_scores(spark, sf_dir):
    """K22."""
    return finish(cl.score_candidates(_candidate_table(spark, sf_dir), ["version"]).select(
        "version", "algorithm", "k", "internal_score", "alignment_score", "stable_support", "best_for_algorithm"))


def consensus(spark, sf_dir):
    """K23."""
    return finish(cl.consensus(cl.score_candidates(_candidate_table(spark, sf_dir), ["version"]), ["version"]))


def dynamic_notes(spark, sf_dir):
    """K25."""
    e = table(spark, sf_dir, "events")
    cap = e.groupBy(L("ds").alias("dataset"), L("strict").alias("mode"), F.concat(L("V"), (F.col("user_id") % 7).cast("string")).alias("version"),
                    F.when(F.col("event_id") % 2 == 0, "static").otherwise("dynamic").alias("regime")).agg((1 + F.count(L(1)) % 3).alias("likely_state_count"))
    return finish(cl.dynamic_notes(cap))


def cluster_search(spark, sf_dir):
    """K-means (20 restarts) and mixtures (4) of k 2 to 5 with 24 bootstrap draws, consensus and verdict."""
    df = results(spark, sf_dir, "hybrid", ("V4",), columns=(*MEASURED, "source_record_id", "valence", "arousal")).where("score is not null")
    scaled = cl.va_quadrant(batched.robust_scale(df, SPACE, ["version"]))
    found = stage(batched.candidates(scaled, SPACE, ["version"], stage), "candidates")
    top = cl.consensus(cl.score_candidates(found, ["version"]), ["version"]).withColumn("label_set_size", L(2))
    return finish(cl.verdict(top))


def components_2d(spark, sf_dir):
    """First two principal components."""
    return finish(cl.principal_components(_clustered(spark, sf_dir), SPACE).select("segment_id", "pc1", "pc2"))


QUERIES = {
    "w01_window_stream": window_stream, "w02_w04_causal_stream": causal_stream, "w03_session_stream": session_stream, "w05_r06_live_preview": preview,
    "k13_robust_scale": robust_scaling, "k16_internal_indices": internal_indices, "k17_agreement": agreement, "k18_va_quadrant": quadrants, "k19_cluster_shares": shares,
    "k22_candidate_scores": candidate_scores, "k23_consensus": consensus, "k25_dynamic_notes": dynamic_notes, "k14_k15_k20_k26_cluster_search": cluster_search, "k27_components": components_2d,
}
