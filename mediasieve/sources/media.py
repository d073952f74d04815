"""Media tables: files below a folder, decoded pictures, probe texts, and the writers of outputs."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediasieve.functions.scalars import base_name
from mediasieve.sources.listing import list_files, list_unsupported
from mediasieve.sources.pieces import publish
from mediasieve.sources.shared import opened

PROBE_SCHEMA = "struct<format: struct<duration: string, tags: map<string,string>>, streams: array<struct<codec_type: string, codec_name: string, width: int, height: int, avg_frame_rate: string, tags: map<string,string>>>>"
#: Bytes of a file that is held in a row at most.
MAX_CONTENT = 1 << 30
MEDIA_COLUMNS = ("path", "rel_path", "ext", "kind", "length", "modificationTime", "content")


def _relative(path: Column, root: str) -> Column:
    bare = F.regexp_replace(path, r"^[a-z0-9]+:/{0,2}(?=/)", "")
    top = root.split(":", 1)[-1].rstrip("/") if ":" in root else root.rstrip("/")
    return F.substring(bare, len("/" + top.lstrip("/")) + 2, 1 << 20)


def _uri(root: str) -> str:
    return root if ":" in root else f"file://{os.path.abspath(root)}"


def with_contents(listed: DataFrame, max_bytes: int = MAX_CONTENT) -> DataFrame:
    """``listed(path, length, ..)`` with the files' bytes, read by the tasks; null where a file is larger or can't be read.

    Rows with a null content are error rows of whatever walks or cleans them;
    ``walk_files`` and ``plan_files`` take files of any size.
    """
    names = [f.name for f in listed.schema.fields]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                path, length = row.column(names.index("path"))[0].as_py(), row.column(names.index("length"))[0].as_py()
                data = None
                if length is not None and length <= max_bytes:
                    try:
                        with opened(path) as f:
                            data = f.read()
                    except OSError:
                        pass
                yield row.append_column("content", pa.array([data], pa.binary()))

    return listed.mapInArrow(read, T.StructType([*listed.schema.fields, T.StructField("content", T.BinaryType())]))


def scan(spark: SparkSession, root: str, max_bytes: int = MAX_CONTENT) -> DataFrame:
    """Supported files below ``root`` with their bytes, as ``list_files`` finds them; larger and unreadable ones have no content."""
    return with_contents(list_files(spark, _uri(root)), max_bytes).select(*MEDIA_COLUMNS)


def unsupported(spark: SparkSession, root: str) -> DataFrame:
    """Relative names of the other files; contents aren't read."""
    return list_unsupported(spark, _uri(root))


def pictures(spark: SparkSession, root: str) -> DataFrame:
    """Decoded PNG and JPEG files as (path, height, width, rgb): alpha flattened on white, gray as three equal channels."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(root)
    return to_rgb(images.select("image.*"))


def to_rgb(images: DataFrame) -> DataFrame:
    """(path, height, width, rgb) of Spark image columns (origin, height, width, nChannels, data in BGR order)."""
    import numpy as np

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rgb = []
            for h, w, n, data in zip(pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"]):
                a = np.frombuffer(data, np.uint8).reshape(h, w, n)
                if n == 1:
                    a = np.repeat(a, 3, axis=2)
                elif n == 4:
                    alpha = a[:, :, 3:].astype(np.float32) / 255
                    a = np.rint(a[:, :, 2::-1] * alpha + 255 * (1 - alpha)).astype(np.uint8)
                else:
                    a = a[:, :, ::-1]
                rgb.append(np.ascontiguousarray(a).tobytes())
            yield pd.DataFrame({"path": pdf["origin"], "height": pdf["height"], "width": pdf["width"], "rgb": rgb})

    return images.select("origin", "height", "width", "nChannels", "data").mapInPandas(convert, "path string, height int, width int, rgb binary")


def probe(text: Column) -> Column:
    """The parsed probe text of a container; null where it isn't JSON."""
    return F.from_json(text, PROBE_SCHEMA)


def stream_facts(parsed: Column) -> list[Column]:
    """Width, height, codec, audio codec, frames a second (0 if unusable) and seconds (0 if none) of a parsed probe text."""
    first = lambda kind: F.get(F.filter(parsed["streams"], lambda s: s["codec_type"] == kind), F.lit(0))
    video, audio = first("video"), first("audio")
    rate = F.split(video["avg_frame_rate"], "/")
    fps = F.try_divide(F.get(rate, F.lit(0)).try_cast("double"), F.coalesce(F.get(rate, F.lit(1)), F.lit("1")).try_cast("double"))
    return [
        video["width"].alias("src_w"),
        video["height"].alias("src_h"),
        video["codec_name"].alias("codec"),
        audio["codec_name"].alias("audio_codec"),
        F.coalesce(fps, F.lit(0.0)).alias("fps"),
        F.coalesce(parsed["format"]["duration"].try_cast("double"), F.lit(0.0)).alias("duration"),
    ]


def write_files(df: DataFrame, root: str, path: str = "out_path", content: str = "content") -> DataFrame:
    """Writes each row's bytes to ``root``/path by the publishing sink; returns (out_path, written, error).

    Files appear when the whole job has succeeded. A failed file becomes a row
    with its error; paths that leave ``root`` are refused. Of rows that share an
    output path one is kept whole.
    """
    done = publish(df.select(F.col(path).alias("path"), F.col(path).alias("out_path"), F.col(content).alias("content")), root)
    return done.select("out_path", F.coalesce("written", F.lit(0)).alias("written"), "error")


def hidden(path: Column) -> Column:
    return F.startswith(base_name(path), F.lit(".")) | F.startswith(base_name(path), F.lit("_detected_"))
