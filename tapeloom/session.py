"""Spark session settings and the shared scratch location."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every job of this package relies on (safe on local and cluster).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "tapeloom") -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("TAPELOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, for checkpoints and written tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local master may do
    without: there the driver and the executors share the one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the whole cluster")
    fallback = tempfile.mkdtemp(prefix="tapeloom-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def full_uri(spark: SparkSession, path: str) -> str:
    """``path`` as every executor reads it: resolved once, here, against Spark's default file system.

    Tasks open files by themselves (WAV recordings); a bare path would mean the
    executor's own disk to them and the shared store to Spark.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    scheme, _, rest = full.partition(":")
    return full if rest.startswith("//") else f"{scheme}://{rest}"


def fan_out(spark: SparkSession, wanted: int | None = None) -> int:
    """Partitions for expensive work on few short rows.

    A given number is kept by the planner; without one it would size partitions by
    the bytes of the rows and run hours of inference in a handful of tasks.
    """
    return wanted or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def new_shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path under :func:`shared_dir`; never reused between runs."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def kept(frame: DataFrame, label: str) -> DataFrame:
    """``frame`` written to the shared folder and read back: what needs it several times computes it once."""
    spark = frame.sparkSession
    path = new_shared_path(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Workers import it for the functions that run in them; on a cluster it is
    not installed there, and locally they may start in another folder.
    """
    context = spark.sparkContext
    if getattr(context, "_tapeloom_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="tapeloom-ship-"), "tapeloom")
    archive = shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(archive)
    context._tapeloom_shipped = True
