"""Session helpers: settings that suit the library, and the checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(name: str = "tidemark", cores: str = "8") -> SparkSession:
    """Local session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.tidemark.spread", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


_LOCAL_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a local one only where none is set in local mode."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL_FOLDER:
        _LOCAL_FOLDER.append(tempfile.mkdtemp(prefix="tidemark-"))
    return _LOCAL_FOLDER[0]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Makes DataFrame.checkpoint() usable, keeping a folder that is already set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


#: The JVM interprets a method above this size; generated code of the scoring chains comes to 50,000 bytes.
METHOD_BYTES = 8000


def compile_all(spark: SparkSession) -> None:
    """Stages whose method the JVM would not compile run as one projection per operator, in methods that it does compile."""
    if int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) > METHOD_BYTES:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(METHOD_BYTES))


#: Bytes of a batch for Python where rows are signals: a worker's memory then does not grow with the rows of its task.
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is written inside goes to the Python workers in batches of at most ``BATCH_BYTES``; the setting is put back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once per application, and its projections compiled code."""
    compile_all(spark)
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tidemark-package-")
    archive = shutil.make_archive(os.path.join(folder, "tidemark"), "zip", os.path.dirname(root), os.path.basename(root))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
