"""Session helpers: build a local session for tests, resolve the checkpoint dir."""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkContext
from pyspark.sql import SparkSession

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "mtlens") -> SparkSession:
    """A local session with AQE on and the UI off (tests and the bench)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.mtlens.spread", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def share_package(sc: SparkContext) -> None:
    """Let Python workers import this package also where the driver found it by its own path."""
    paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGE_ROOT not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *filter(None, paths)])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is. Only when it is unset on a local master (tests) a fresh temporary folder is
    created, and removed when the driver's JVM ends; on a cluster that is an error,
    since executors do not share temporary folders.
    """
    sc = spark.sparkContext
    share_package(sc)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="mtlens-ckpt-")
        path = sc._jvm.org.apache.hadoop.fs.Path(configured)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    sc.setCheckpointDir(configured)
    return configured


BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let no Arrow batch between the JVM and Python hold much more than ``BATCH_BYTES`` (one row at least); a bound set elsewhere is kept."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))
