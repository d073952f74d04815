"""A Spark data source that lists files itself: folders are planned into partitions, and every file and failure is a row."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mediasieve.functions.scalars import base_name, extension, media_kind
from mediasieve.sources.shared import file_system

FORMAT = "media_listing"
LISTED = pa.schema([("path", pa.string()), ("rel_path", pa.string()), ("length", pa.int64()), ("modificationTime", pa.timestamp("us", tz="UTC")), ("error", pa.string())])
_LISTED_SQL = "path string, rel_path string, length long, modificationTime timestamp, error string"


class Folders(InputPartition):
    """Folders to list: (path, whether with all below it or its own files alone)."""

    def __init__(self, folders: list[tuple[str, bool]]):
        super().__init__(tuple(folders))
        self.folders = folders


class MediaListing(DataSource):
    """``spark.read.format("media_listing")``: files below ``root`` as (path, rel_path, length, modificationTime, error).

    Options: ``root`` (a URI), ``fan_out`` (256): folders are opened on the
    driver, level by level, until there are so many to hand out; what lies below
    them is listed in the tasks. ``tasks`` (32): partitions at most, among which
    folders are dealt in turn. A folder that can't be listed is a row with an
    error.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _LISTED_SQL

    def reader(self, schema) -> DataSourceReader:
        return MediaListingReader(self.options)


class MediaListingReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["root"].rstrip("/")
        self.fan_out, self.tasks = int(options.get("fan_out", 256)), int(options.get("tasks", 32))

    def partitions(self) -> list[InputPartition]:
        system, top = file_system(self.root)
        shallow: list[tuple[str, bool]] = []
        level = [top.rstrip("/")]
        while level and len(level) < self.fan_out:
            below: list[str] = []
            for path in level:
                try:
                    below += [i.path for i in system.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.Directory]
                except OSError:
                    pass  # the task that lists it reports it
                shallow.append((path, False))
            level = below
        folders = [*shallow, *((path, True) for path in level)]
        return [Folders(folders[k :: self.tasks]) for k in range(min(self.tasks, len(folders)))]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        system, top = file_system(self.root)
        top = top.rstrip("/")
        prefix = self.root[: len(self.root) - len(top)] if self.root.endswith(top) else "file://"
        todo, rows = list(partition.folders), []
        row = lambda path, length, when, error: {"path": prefix + path, "rel_path": path[len(top) + 1 :], "length": length, "modificationTime": when, "error": error}
        while todo:
            folder, deep = todo.pop()
            try:
                entries = system.get_file_info(fs.FileSelector(folder))
            except OSError as e:
                rows.append(row(folder, None, None, f"folder not listed: {e}"))
                continue
            for i in entries:
                if i.type == fs.FileType.Directory:
                    todo += [(i.path, True)] if deep else []
                elif i.type == fs.FileType.File:
                    rows.append(row(i.path, i.size, i.mtime, None))
                else:
                    rows.append(row(i.path, None, None, "neither file nor folder"))
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_pylist(rows, LISTED)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, LISTED)


def list_all(spark: SparkSession, root: str, fan_out: int = 256) -> DataFrame:
    """(path, rel_path, ext, kind, length, modificationTime, error) of everything below ``root``, without reading it.

    Files whose own name begins with a dot are left out; folders named so are
    entered, and names that begin with an underscore are as good as others.
    """
    spark.dataSource.register(MediaListing)
    tasks = 4 * spark.sparkContext.defaultParallelism
    listed = spark.read.format(FORMAT).option("root", root).option("fan_out", fan_out).option("tasks", tasks).load()
    shown = listed.where(F.col("error").isNotNull() | ~F.startswith(base_name(F.col("rel_path")), F.lit(".")))
    return shown.select("path", "rel_path", extension(F.col("rel_path")).alias("ext"), media_kind(F.col("rel_path")).alias("kind"), "length", "modificationTime", "error")


def list_files(spark: SparkSession, root: str, fan_out: int = 256) -> DataFrame:
    """The supported files of ``list_all``, and its errors."""
    return list_all(spark, root, fan_out).where("kind IS NOT NULL OR error IS NOT NULL")


def list_unsupported(spark: SparkSession, root: str, fan_out: int = 256) -> DataFrame:
    """Relative names of the other files."""
    return list_all(spark, root, fan_out).where("kind IS NULL AND error IS NULL").select("rel_path")
