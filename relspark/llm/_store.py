"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; a temporary one only for a local session without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor shares")
        base = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="relspark-"))
    small_batches(spark)
    path = f"{base.rstrip('/')}/relspark-{uuid.uuid4().hex}"
    atexit.register(_quiet_remove, spark, path)
    return path


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Let Arrow batches of this session hold at most ``most`` bytes: long texts then take no more of a task's memory than short ones."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > most:
        spark.conf.set(key, str(most))


def keep(df: DataFrame, name: str = "t", folder: str | None = None) -> DataFrame:
    """Write the rows once and read them back: later steps neither recompute them nor depend on an executor's disk.

    The write's own shuffle files go as soon as it ends, and not only when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{name}"
    own = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, own) if own is not None else spark.conf.unset(CLEAN_UP)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _quiet_remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session has ended; the cluster's own clean-up takes the folder
        pass
