"""Intermediate results that outlive executors: tables in the shared folder."""

from __future__ import annotations

import atexit
import pickle
import re
import shutil
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


#: Setting by which a finished query's shuffle files go at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; without one, a folder of this machine if all of Spark runs in this process, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", master := spark.sparkContext.master):
            raise RuntimeError(f"on {master} intermediate tables need a folder that all machines share: set spark.checkpoint.dir")
        folder = f"file://{tempfile.gettempdir()}/concord-checkpoints"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)  # without a scheme it is the default file system's
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder's URI there; it goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/concord-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this module."""
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # the session has ended before: only a mounted folder can be reached
        if path.startswith("file:"):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here and a lost executor costs nothing.

    The shuffle files of the query that wrote it aren't needed any more and go at once.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.concord_folder = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for df in frames:
        remove(df.sparkSession, df.concord_folder)


def shared(spark: SparkSession, value):
    """Broadcast of any value, its class included: executors need no copy of this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(broadcast):
    """The value of a ``shared`` broadcast."""
    return pickle.loads(broadcast.value)
