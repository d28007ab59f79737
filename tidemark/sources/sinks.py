"""Table sinks: partitioned Parquet, CSV with JSON-encoded nested columns, nested JSON summary."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import shared_folder

_NESTED = (T.ArrayType, T.MapType, T.StructType)


def write_parquet(df: DataFrame, path: str, partitions=("dataset", "mode", "version")) -> None:
    df.write.mode("errorifexists").partitionBy(*partitions).parquet(path)


def flat_text(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for the CSV sink."""
    return df.select(*[
        (F.to_json(f.name).alias(f"{f.name}_json") if isinstance(f.dataType, _NESTED) else F.col(f.name)) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    flat_text(df).write.mode("errorifexists").option("header", True).csv(path)


def summary(results: DataFrame) -> DataFrame:
    """One nested record per (dataset, mode) with an entry per version."""
    per = results.groupBy("dataset", "mode", "version").agg(F.count("score").alias("valid_segments"), F.avg("score").alias("mean_score"))
    entry = F.struct("version", "valid_segments", "mean_score")
    return per.groupBy("dataset", "mode").agg(F.sort_array(F.collect_list(entry)).alias("versions"))


def write_summary(results: DataFrame, path: str) -> None:
    summary(results).write.mode("errorifexists").json(path)


def round_trip_counts(results: DataFrame) -> DataFrame:
    """Writes through every sink and counts what can be read back."""
    spark = results.sparkSession
    base = f"{shared_folder(spark)}/sinks-{uuid.uuid4().hex}"
    write_parquet(results, f"{base}/parquet")
    stored = spark.read.parquet(f"{base}/parquet")
    write_csv(stored, f"{base}/csv")
    write_summary(stored, f"{base}/summary")
    readers = {
        "parquet": stored, "csv": spark.read.option("header", True).csv(f"{base}/csv"),
        "json": spark.read.json(f"{base}/summary").select(F.explode("versions").alias("v")).select("v.*"),
    }
    parts = [r.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("sink"), "rows") for n, r in readers.items()]
    return reduce(DataFrame.unionByName, parts)
