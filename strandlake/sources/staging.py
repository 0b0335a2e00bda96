"""Tables written once to the folder that driver and executors share, and the package on its way to the workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets one of its
    own; a cluster has no folder that could be guessed."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is not set: executors of {master} can't see a folder of the driver")
        path = tempfile.mkdtemp(prefix="strandlake-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared folder. It is removed, with what it holds, when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(at)
    system.deleteOnExit(at)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later steps neither recompute it nor lose it with an executor."""
    path = f"{new_folder(df.sparkSession, label)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends the package to all Python workers, once an application; they need no path of the driver."""
    context = spark.sparkContext
    if getattr(context, "_strandlake_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="strandlake-")  # the driver's own: Spark copies the file to the executors
    path = os.path.join(folder, "strandlake.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(_PACKAGE):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    context.addPyFile(path)
    context._strandlake_shipped = True
