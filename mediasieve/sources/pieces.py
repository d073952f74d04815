"""A Spark sink of files: outputs given as ranges of inputs are staged by the tasks and published when the job commits."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from mediasieve.functions.containers import Piece, assembled
from mediasieve.functions.scalars import escapes
from mediasieve.functions.views import FileView
from mediasieve.sources.shared import file_system, fresh_folder, opened, stored

FORMAT = "media_pieces"
_ROW = "path string, out_path string, pieces array<struct<length:long,offset:long,new:binary>>, content binary, error string, tag string"
_DONE = "path string, out_path string, written long, error string, tag string"
#: Files that a writer's own commit renames at a time.
_MOVERS = 32


@dataclass
class Staged(WriterCommitMessage):
    """Where a task has listed its drafts."""

    manifest: str


class MediaPieces(DataSource):
    """``df.write.format("media_pieces")``: a file for each row (path, out_path, pieces, content, error, tag).

    Options: ``root``, a URI, and ``report``, a folder for the rows' outcomes;
    with ``later`` and ``job`` drafts stay staged, and ``report`` gets the lists
    of them, ``staged.jsonl``.
    A file's bytes are ``content`` or, where that is null, its ``pieces``:
    ranges of ``path``, new bytes, or zeros. Rows with an error, or with
    neither, are only reported. ``tag`` is any text that the report repeats.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _ROW

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return PieceWriter(self.options["root"].rstrip("/"), self.options["report"].rstrip("/"), self.options.get("job", uuid.uuid4().hex), "later" in self.options)


class PieceWriter(DataSourceArrowWriter):
    """Drafts lie in a staging folder of the job. The commit moves those that a finished task has listed and drops the folder; so does an abort, without moving."""

    def __init__(self, root: str, report: str, job: str, later: bool = False):
        self.root, self.report, self.job, self.later = root, report, job, later

    def _staging(self) -> tuple[fs.FileSystem, str, str]:
        system, top = file_system(self.root)
        return system, top, f"{top}/.staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        system, _, staging = self._staging()
        task = uuid.uuid4().hex
        folder = f"{staging}/{task}"
        system.create_dir(folder, recursive=True)
        manifest = f"{staging}/{task}.jsonl"
        try:
            with system.open_output_stream(manifest) as listed:
                n = 0
                for batch in iterator:
                    for row in _rows(batch):
                        done = self._stage(system, f"{folder}/{n}", row)
                        listed.write(json.dumps(done | {"draft": f"{folder}/{n}"}).encode() + b"\n")
                        n += 1
        except BaseException:
            system.delete_dir(folder)
            raise
        return Staged(manifest)

    def _stage(self, system: fs.FileSystem, draft: str, row: dict) -> dict:
        done = {"path": row["path"], "out_path": row["out_path"], "written": None, "error": row["error"], "tag": row["tag"]}
        if row["error"] is None and row["content"] is None and row["pieces"] is None:
            return done | {"error": "nothing to write"}
        if row["error"] is not None:
            return done
        try:
            with system.open_output_stream(draft) as out:
                if row["content"] is not None:
                    out.write(row["content"])
                else:
                    with opened(row["path"]) as f:
                        for window in assembled(FileView(f, f.size()), [Piece(**p) for p in row["pieces"]]):
                            out.write(window)
                written = out.tell()
        except OSError as e:
            return done | {"error": f"{type(e).__name__}: {e}"}
        return done | {"written": written}

    def commit(self, messages: list[Staged]) -> None:
        system, top, staging = self._staging()
        report_system, report = file_system(self.report)
        report_system.create_dir(report, recursive=True)
        if self.later:
            with report_system.open_output_stream(f"{report}/staged.jsonl") as out:
                out.write(b"".join(json.dumps({"manifest": m.manifest}).encode() + b"\n" for m in messages if m is not None))
            return
        made: set[str] = set()

        def publish(line: bytes) -> None:
            _move(system, top, json.loads(line), made)

        with ThreadPoolExecutor(_MOVERS) as pool:
            for m in messages:
                if m is None:
                    continue
                with system.open_input_stream(m.manifest) as listed:
                    lines = listed.read().splitlines()
                for _ in pool.map(publish, lines):
                    pass
                with report_system.open_output_stream(f"{report}/{os.path.basename(m.manifest)}") as out:
                    out.write(b"".join(line + b"\n" for line in lines))
        _drop(system, staging)

    def abort(self, messages: list[Staged]) -> None:
        system, _, staging = self._staging()
        _drop(system, staging)


def _move(system: fs.FileSystem, top: str, row: dict, made: set[str]) -> None:
    """The row's draft becomes its file, if it has one; ``made`` are the folders that are there."""
    if row["written"] is None:
        return
    target = f"{top}/{row['out_path']}"
    if (folder := os.path.dirname(target)) not in made:
        system.create_dir(folder, recursive=True)
        made.add(folder)
    try:
        system.move(row["draft"], target)
    except OSError:  # moved by an attempt that was lost afterwards?
        draft, there = system.get_file_info([row["draft"], target])
        if draft.type != fs.FileType.NotFound or there.type != fs.FileType.File:
            raise


def _moved(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The outcomes of rows whose drafts the given manifests list, once these are moved."""
    names = ("path", "out_path", "written", "error", "tag")
    schema = pa.schema([(n, pa.int64() if n == "written" else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = file_system(root)
        made: set[str] = set()
        for manifest in (m for batch in batches for m in batch.column(0).to_pylist()):
            with system.open_input_stream(manifest) as listed:
                rows = [json.loads(line) for line in listed.read().splitlines()]
            for row in rows:
                _move(system, top, row, made)
            for k in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pylist([{n: row[n] for n in names} for row in rows[k : k + 10_000]], schema)

    return run


def _drop(system: fs.FileSystem, folder: str) -> None:
    if system.get_file_info(folder).type == fs.FileType.Directory:
        system.delete_dir(folder)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows in turn: not all contents of a large batch are Python objects at a time."""
    some = max(1, batch.num_rows * (1 << 20) // max(batch.nbytes, 1))
    for k in range(0, batch.num_rows, some):
        yield from batch.slice(k, some).to_pylist()


def publish(files: DataFrame, root: str, out_path: Column | str = "out_path", names: DataFrame | None = None) -> DataFrame:
    """Writes ``files(path, out_path, pieces and/or content[, error, tag])`` below ``root``; returns (path, out_path, written, error, tag).

    Nothing is visible before all is staged; then tasks move what finished tasks
    have listed, so no file passes through the driver. What failed or lost
    attempts have staged goes with the staging folder. Output paths
    that leave ``root``, and all but the first (by path) of rows that share
    one, are refused. A row that can't be written is an error row. ``names(path,
    out_path)`` are those of the rows without an error, where they can be had
    without making contents, which are then made once.
    """
    spark = files.sparkSession
    spark.dataSource.register(MediaPieces)
    name = F.col(out_path) if isinstance(out_path, str) else out_path
    has = lambda c, kind: F.col(c) if c in files.columns else F.lit(None).cast(kind)
    rows = files.select("path", name.alias("out_path"), has("pieces", "array<struct<length:long,offset:long,new:binary>>").alias("pieces"), has("content", "binary").alias("content"), has("error", "string").alias("error"), has("tag", "string").alias("tag"))
    # Names that are met twice are few, and alone are joined: bytes are not shuffled for the others.
    twice = (rows.where("error IS NULL") if names is None else names).groupBy("out_path").agg(F.count("*").alias("n"), F.min("path").alias("first")).where("n > 1").select("out_path", "first")
    twice = twice if names is None else stored(twice)
    judged = rows.join(twice, "out_path", "left")
    refused = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("out_path").isNull() | escapes(F.col("out_path")), "path escapes the output folder").when(F.col("path") > F.col("first"), "output path is taken")
    root, report, job = root.rstrip("/"), fresh_folder(spark, "published"), uuid.uuid4().hex
    out = judged.select("path", "out_path", "pieces", "content", refused.alias("error"), "tag").write.format(FORMAT).mode("append")
    out.option("root", root).option("report", report).option("job", job).option("later", "true").save()
    try:
        staged = spark.read.schema("manifest string").json(f"{report}/staged.jsonl")
        staged.repartition(max(1, staged.count())).mapInArrow(_moved(root), _DONE).write.json(f"{report}/done")
    finally:
        PieceWriter(root, report, job).abort([])
    return spark.read.schema(_DONE).json(f"{report}/done")
