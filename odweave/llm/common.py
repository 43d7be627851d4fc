"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Rows in one Arrow batch. Texts of 100 KB are common, so batches stay small.
ARROW_ROWS = 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_ready(spark: SparkSession) -> None:
    """Bound the rows in an Arrow batch, so that long texts fit into a Python worker.

    Workers on this machine also get the driver's path to this package, where it isn't installed.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{root}:{env['PYTHONPATH']}" if env.get("PYTHONPATH") else root


#: The folders of applications in local mode that name none.
_local: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only in local mode, as in tests, a temporary folder
    of this machine takes its place where it is unset, one for each application; a cluster without it raises.
    A folder without a scheme is on Spark's default file system, which the path then names: tasks that open files
    themselves go where Spark goes.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors share")
        of = spark.sparkContext.applicationId
        base = _local[of] = _local.get(of) or "file://" + tempfile.mkdtemp(prefix="spark-")
    return qualified(spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of its file system, which is Spark's default one where it has none."""
    if "://" in path:
        return path
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toString()


#: Spark's setting by which a query's shuffle files go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again.

    The shuffle files behind the table go with the write that needed them.
    """
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that no plan reads any more, as what came of them is written too."""
    for t in tables:
        remove(t.sparkSession, t.written_to)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of ``scratch`` with all that is in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stretches(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of each run of a sorted array: the work grows with the values that occur, not with their range."""
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    yield from zip(values[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(values)], strict=True) if len(values) else ()


def file_system(uri: str):
    """(file system, path) of a URI in the shared folder, for tasks that write or read raw bytes there."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    if "://" not in uri:
        raise ValueError(f"{uri} doesn't name its file system")
    return fs.FileSystem.from_uri(uri)


def give_back() -> None:
    """Return memory that this process has freed to the system, where its C library can."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def attempt_name() -> str:
    """A name for a file of this task attempt: an attempt that is lost or repeated leaves others' files alone."""
    from pyspark import TaskContext

    c = TaskContext.get()
    return f"part-{c.partitionId():06d}-{c.taskAttemptId()}" if c else f"part-{uuid.uuid4().hex}"
