"""Spark session set-up and the settings the plans rely on."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every plan relies on. Core plans use no broadcast hint but for the few rows of a draw's cut: Catalyst and AQE
# broadcast a side only when its measured size is under spark.sql.autoBroadcastJoinThreshold,
# and AQE splits a hot join partition into pieces of the advisory size.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_shipped: set[str] = set()


def _ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers run its kernels."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        with tempfile.TemporaryDirectory(prefix="varicube-ship-") as folder:
            archive = shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
            # The driver serves added files from their path, so the archive lives as long as the process.
            kept = Path(archive).rename(f"{folder}.zip")
        atexit.register(kept.unlink, missing_ok=True)
        context.addPyFile(str(kept))
        _shipped.add(context.applicationId)


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    _ship_package(spark)
    return spark


def build_session(app: str = "varicube", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.ui.showConsoleProgress", "false")
    if master is not None:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def spread(scan: DataFrame) -> DataFrame:
    """Redistribute a scan that is split into fewer tasks than there are cores.

    Unsplittable input (gzip text, a file of one row group) would run the annotation work on a few cores.
    A scan that already has a task per core passes through, so a large table is never shuffled here.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Only a local session, whose tasks share its disk, may leave it unset."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if context.master == "local" or context.master.startswith("local["):
        return _local_checkpoint_folder()
    raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


@functools.cache
def _local_checkpoint_folder() -> str:
    folder = tempfile.mkdtemp(prefix="varicube-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(spark))


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to the checkpoint folder and continue from the written copy.

    Used where two branches must see one identical partitioning, and between iterations.
    """
    _ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def stored(frame: DataFrame) -> DataFrame:
    """``frame`` written as Parquet below the checkpoint folder and read from there.

    For loops: a checkpoint keeps the size estimate of its plan, and every join multiplies estimates, so after some
    rounds the planner works on numbers with thousands of digits. Files have a size of their own.
    """
    path = f"{checkpoint_folder(frame.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
