"""Small helpers shared by the operators: text batches as byte buffers, row keys, word bytes."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import shared_folder

#: A-Z to a-z on UTF-8 bytes; every other byte stays, so non-ASCII letters are not touched.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Texts are worked on in slices of about this many bytes, so a worker's memory does not depend on the batch size.
SLICE_BYTES = 1 << 21


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES):
    """Yields (first row, bytes, offsets) for runs of rows; null texts are empty. Offsets start at zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        yield first, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def task_base() -> int:
    """A number that no other task of the same job shares: the high bits of row keys made inside tasks."""
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 33


def own_columns(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns only, cast to the given types; other columns (of whatever name) are left out.

    A column that the table lacks becomes null, so that an operator meets one fixed schema.
    """
    there = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in there else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])


def int_column(values, kind=np.int64) -> pa.Array:
    return pa.array(np.asarray(values, kind))


def packed(values, kind: str = "<u4") -> bytes:
    """Unsigned numbers, compressed by byte planes."""
    a = np.ascontiguousarray(values, kind)
    return zlib.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), 1)


def unpacked(data: bytes, kind: str = "<u4") -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def byte_alphabet() -> dict[int, str]:
    """The letters that a byte-level tokenizer writes bytes as: visible Latin-1 as it is, the others from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


class Scratch:
    """Tables of an iterative job in the shared folder; each is deleted when its readers are done."""

    def __init__(self, df: DataFrame):
        self.spark, self.folder, self.paths = df.sparkSession, f"{shared_folder(df.sparkSession)}/staged/{uuid.uuid4().hex}", {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the rows and returns a scan of the files, which cuts the lineage and survives lost executors."""
        path = f"{self.folder}/{len(self.paths)}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            if id(table) in self.paths:
                path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths[id(table)][0])
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
                self.paths[id(table)] = ("", None)
