"""The folder that the driver and all executors share, for tables that one job leaves to the next."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder, not yet made, in the one that ``spark.checkpoint.dir`` names, by its full address.

    Where it is unset, a temporary folder takes its place in local mode, and a cluster raises.
    """
    base, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not base:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors share")
        base = _local[context.applicationId] = _local.get(context.applicationId) or "file://" + tempfile.mkdtemp(prefix="spark-")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder and what is in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
