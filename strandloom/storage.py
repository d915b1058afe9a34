"""The folder that executors share, for checkpoints and tables between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` or set by the caller. In local mode alone one is made where none is set; a cluster must name one that all its machines share."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="strandloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path


def local(path: str) -> str:
    """The path of a mounted file system in a URL of it, for Python's own file functions."""
    return path.removeprefix("file:").replace("//", "/") if path.startswith("file:") else path


def stored(df: DataFrame, schema: str | None = None, **options) -> DataFrame:
    """``df`` written as Parquet to the shared folder, with options of the writer, and read again."""
    path = f"{checkpoint_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder or file, on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file of any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a small file to any store that Spark writes: under another name first, so that a file of this name is whole."""
    own = spark._jvm.org.apache.hadoop.fs.Path
    at, new = own(path), own(f"{path}.{uuid.uuid4().hex}")
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = store.create(new, True)
    try:
        stream.write(data)
    finally:
        stream.close()
    store.delete(at, False)
    if not store.rename(new, at):
        raise OSError(f"cannot write {path}")
