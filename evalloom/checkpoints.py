"""Cutting the lineage of a plan that grows from round to round, and scratch tables in the shared folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    A session on one machine that has no such folder, as in tests, gets a temporary one; on a cluster
    that is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="evalloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver exits."""
    path = f"{shared_folder(spark)}/evalloom/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a path of any file system that Spark reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                removed(spark, path)
        except Exception:  # noqa: BLE001 - the session or its JVM may be gone already
            return


def cut(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read back."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
