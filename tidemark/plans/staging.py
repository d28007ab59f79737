"""Staged tables: an expensive intermediate is written once and read back with column pruning."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tidemark.session import shared_folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and returns a scan of the files.

    Later steps read only the columns they need, do not recompute the scores, and survive lost
    executors because the files are on shared storage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


_STAGED: list[str] = []


def clear_staged(spark) -> int:
    """Deletes the tables staged by this application, once their readers are finished. Returns how many."""
    paths, jvm = _STAGED.copy(), spark.sparkContext._jvm
    _STAGED.clear()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return len(paths)
