"""Cutting lineage in the folder that driver and executors share, and opening files by URI inside tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import NativeFile, fs
from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only in a local session that names none, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` stored under the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table under the shared folder: as ``checkpointed``, but Spark plans joins by its true size, not by what its inputs' files let it guess."""
    folder = fresh_folder(df.sparkSession, "stored")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """The URI of a folder of its own under the shared one; nothing is made there yet."""
    base = shared_base(spark)
    return f"{base if ':' in base else 'file://' + base}/{name}-{uuid.uuid4().hex}"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs) and the path inside it."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    if uri.startswith("file://"):
        return fs.LocalFileSystem(), uri[len("file://") :]  # names as they are: nothing in them is an escape
    return fs.FileSystem.from_uri(uri)


def opened(uri: str) -> NativeFile:
    """A file for reading at any offset."""
    system, path = file_system(uri)
    return system.open_input_file(path)
