"""Folders that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_made: dict[str, SparkSession] = {}


def work_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, deleted when the driver ends or by ``clean``.

    Where that is unset a temporary folder serves in local mode; on a cluster it
    is an error, as executors don't see each other's disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="quirewell-"))
            atexit.register(shutil.rmtree, _local[0], True)
        base = "file://" + _local[0]
    if not _made:
        atexit.register(clean)
    path = f"{base.rstrip('/')}/quirewell-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def clean() -> None:
    """Delete the work folders of this driver; results that are read from them end with them."""
    for path, spark in list(_made.items()):
        del _made[path]
        with contextlib.suppress(Exception):  # the session may have ended
            delete(spark, path)


def write(df: DataFrame, path: str) -> DataFrame:
    """``df`` as Parquet below ``path``, read back: computed once, and there for later attempts."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
