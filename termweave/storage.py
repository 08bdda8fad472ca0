"""Tables written to the folder that all executors share, to be computed once."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without the setting gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_dir()


@functools.cache
def _local_dir() -> str:
    holder = tempfile.TemporaryDirectory(prefix="termweave-")
    atexit.register(holder.cleanup)
    return holder.name


def _own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/termweave-{spark.sparkContext.applicationId}"
    if path not in _own:
        _own.add(path)
        atexit.register(_remove, spark, path)
    return path


_own: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(target, True)
    except (Py4JError, OSError, AttributeError):  # the JVM has ended; what is left has the application's name
        pass


def written(df: DataFrame) -> DataFrame:
    """df computed once, written as Parquet to the shared folder and read again.

    It cuts the lineage like a checkpoint: a lost executor costs no recomputation
    of what came before. The tables of an application are in a folder of its own, which
    is deleted when its driver ends.
    """
    path = f"{_own_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more."""
    path = getattr(df, "_written_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def put_bytes(spark: SparkSession, path: str, body: bytes) -> None:
    """Write a file, whatever file system its path names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(bytearray(body))
    finally:
        out.close()
