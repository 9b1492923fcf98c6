"""Durable intermediate results.

Lineage is cut only through files in the folder that all executors share: the one the session names in
``spark.checkpoint.dir``. A folder of our own is made only where that setting is empty on one machine (tests, bench),
and it is removed when the process ends; on a cluster the missing setting is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; sets the context's checkpoint folder as well if nobody did.

    Raises ValueError where executors run on other machines and no folder is named, since no folder of this machine
    would do."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="keelson-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = "file://" + folder
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path.rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_dir(spark)}/keelson-{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder; later reads survive the loss of any executor.

    It is a parquet table rather than ``checkpoint()``, since a checkpoint keeps the constraints of the plan it came
    from, and those grow with every step of an iterative operator until planning takes longer than the work.
    """
    path = workspace(df.sparkSession, "step")
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_written: list[str] = []


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables of this process; results that were not read yet become unreadable."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
