"""Session helpers shared by every query: worker import path, shared scratch folder, sizing."""

from __future__ import annotations

import gc
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver was started.

    On a cluster whose nodes do not share this folder, ship the package with ``--py-files``;
    the extra entry on the workers' path is then simply unused.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none (tests, local mode), the one folder of this process is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file:///tmp/docweave-{os.getpid()}"
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage reliably: written to the shared folder, so that a lost executor loses nothing."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table written between two steps."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession) -> None:
    """Lets the session's cleaner find the shuffle files and checkpoints that nothing refers to any more.

    It learns of them when the driver's memory is collected, which on a quiet driver may take longer than
    a query of many steps lasts; till then every step's files stay on disk.
    """
    gc.collect()
    spark._jvm.System.gc()


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the frame's size; for a file scan, the files' size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of documents that one task of Python work should have at most before it pays to deal them out.
TASK_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """Small inputs dealt over all cores before Python work; larger ones stay as their files are split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size_in_bytes(df) < cores * TASK_BYTES else df
