"""Parquet table access and the fixture views derived from the shared test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources import fixture_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of a table. ``spark.tidemark.spread`` (set by local sessions only) deals a small single file out to cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    spread = spark.conf.get("spark.tidemark.spread", None)
    return df.repartition(int(spread)) if spread else df


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view such as ``fx_features`` as a lazy DataFrame over the Parquet tables."""
    body, sources = fixture_sql.spark_view(name)
    return spark.sql(body, **{s: table(spark, sf_dir, s) for s in sources})
