"""Media columns: payloads stored as images in archives, read through a Spark data source.

A payload is a text's UTF-8 bytes with zero bytes up to a positive multiple of
64. It is stored as an 8-bit gray PNG image, 64 samples wide; a text chunk
``bytes`` has the number of bytes before padding. Members of a ZIP archive are
stored as they are; the archive's directory gives their offsets.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mediasieve.llm.batches import bound_batches, slices
from mediasieve.llm import store

WIDTH = 64
#: Fixed by the PNG format.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
FORMAT = "media_archives"
#: Members of an archive at most, so that its directory stays in the 32-bit form.
MAX_MEMBERS = 60_000
#: Fixed part of an entry of a ZIP directory.
_ENTRY = struct.Struct("<4s6H3I5H2I")
_MEMBERS = "archive string, member string, offset long, media binary"
_MANIFEST = "archive string, begin long, end long, dir_begin long, dir_end long, n_members long"


def pad(data: bytes) -> bytes:
    return data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH), b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_image(data: bytes, level: int = 1) -> bytes:
    """The stored form of unpadded bytes."""
    rows = np.frombuffer(pad(data), np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # a filter byte (none) before each line
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0%d" % len(data)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_image(media: bytes) -> tuple[bytes, int]:
    """The samples and the number of bytes before padding; ValueError if damaged."""
    if media[:8] != PNG_SIGNATURE:
        raise ValueError("no PNG signature")
    at, height, n_bytes, parts = 8, -1, -1, []
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != int.from_bytes(media[at + 8 + size : at + 12 + size], "big"):
            raise ValueError(f"chunk at {at} fails its checksum")
        if kind == b"IHDR":
            height = struct.unpack_from(">II", data)[1]
        elif kind == b"tEXt" and data.startswith(b"bytes\0"):
            n_bytes = int(data[6:])
        elif kind == b"IDAT":
            parts.append(data)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, WIDTH + 1)
    return lines[:, 1:].tobytes(), n_bytes


def write_archives(docs: DataFrame, where: str, archive_bytes: int = 256 << 20, mark_bytes: int = 1 << 20) -> None:
    """Stores every whole text of ``docs(doc_id, text)`` in archives under the folder ``where``.

    Each task writes archives of about ``archive_bytes``, no shuffle. Members are
    named by doc_id (``null`` without one); null text counts as empty; repeated
    rows are members of their own. A table ``manifest`` has a row for about
    every ``mark_bytes`` of the archives of the tasks that counted (others are
    left over from lost attempts): the range of bytes in which members begin,
    and that of their entries in the archive's directory. Further columns are
    ignored.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = stream = name = None

        def close() -> pa.RecordBatch:
            archive.close()
            stream.close()
            return pa.RecordBatch.from_pylist(_marks(name, archive, mark_bytes))

        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist()):
                if archive is None:
                    name = f"{where}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zip"
                    stream = store.create(name)
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                archive.writestr(zipfile.ZipInfo(f"{'null' if doc_id is None else doc_id}.png"), encode_image(text or b""))
                if stream.tell() >= archive_bytes or len(archive.filelist) >= MAX_MEMBERS:
                    yield close()
                    archive = None
        if archive is not None:
            yield close()

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows.mapInArrow(write, _MANIFEST).write.parquet(f"{where}/manifest")


def _entry_bytes(m: zipfile.ZipInfo) -> int:
    """Bytes of a member's entry in the directory of an archive below the limits of the 64-bit form."""
    return _ENTRY.size + len(m.filename.encode()) + len(m.extra) + len(m.comment)


def _marks(name: str, archive: zipfile.ZipFile, mark_bytes: int) -> list[dict]:
    marks: list[dict] = []
    at = archive.start_dir
    for m in archive.filelist:
        if not marks or m.header_offset - marks[-1]["begin"] >= mark_bytes:
            marks.append({"archive": name, "begin": m.header_offset, "end": 0, "dir_begin": at, "dir_end": 0, "n_members": 0})
        at += _entry_bytes(m)
        marks[-1] |= {"dir_end": at, "n_members": marks[-1]["n_members"] + 1}
    for mark, after in zip(marks, [m["begin"] for m in marks[1:]] + [archive.start_dir]):
        mark["end"] = after
    return marks


class ByteRange(InputPartition):
    """The members of an archive whose headers begin in [begin, end), and where their entries in the directory are, if that is known."""

    def __init__(self, archive: str, begin: int, end: int, dir_begin: int = 0, dir_end: int = 0):
        super().__init__((archive, begin, end))
        self.archive, self.begin, self.end, self.dir_begin, self.dir_end = archive, begin, end, dir_begin, dir_end


class MediaArchives(DataSource):
    """``spark.read.format("media_archives")``: members of ZIP archives as (archive, member, offset, media).

    Options: ``manifest`` (a folder with the table that ``write_archives``
    makes), or ``path`` (a folder of archives), or ``archives`` (their URIs, one
    a line); ``range_bytes`` (8388608), ``batch_bytes`` (4194304), ``retries``
    (3).
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return MediaArchiveReader(self.options)


class MediaArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.options = options
        self.range_bytes = int(options.get("range_bytes", 8 << 20))
        self.batch_bytes = int(options.get("batch_bytes", 4 << 20))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[InputPartition]:
        """Byte ranges of the archives.

        With a manifest no archive is opened here. Without one the directory's
        place is read from the end of each archive; the tasks read the entries.
        """
        if manifest := self.options.get("manifest"):
            return self._planned(manifest) or [ByteRange("", 0, 0)]
        listed = self.options.get("archives")
        archives = listed.split("\n") if listed else store.names(self.options["path"], ".zip") if listed is None else []
        found: list[InputPartition] = []
        for archive in archives:
            with store.open_file(archive) as f:
                end = directory_begin(f)
            found += [ByteRange(archive, a, min(a + self.range_bytes, end)) for a in range(0, end, self.range_bytes)]
        return found or [ByteRange("", 0, 0)]

    def _planned(self, manifest: str) -> list[InputPartition]:
        """The marks of each archive, put together to ranges of about ``range_bytes``."""
        found: list[ByteRange] = []
        for name in store.names(manifest, ".parquet"):
            with store.open_file(name) as f:
                marks = pq.read_table(f)
            for m in marks.sort_by([("archive", "ascending"), ("begin", "ascending")]).to_pylist():
                last = found[-1] if found else None
                if last and last.archive == m["archive"] and m["end"] - last.begin <= self.range_bytes:
                    found[-1] = ByteRange(last.archive, last.begin, m["end"], last.dir_begin, m["dir_end"])
                else:
                    found.append(ByteRange(m["archive"], m["begin"], m["end"], m["dir_begin"], m["dir_end"]))
        return list(found)

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if partition.end == 0:
            return
        schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("media", pa.binary())])
        source = _Retried(partition.archive, self.retries)
        rows, size = [], 0
        for m in source.do(lambda f: members_of(f, partition)):
            media = source.do(lambda f, m=m: fetch(f, m))
            rows.append({"archive": partition.archive, "member": m.filename, "offset": m.header_offset, "media": media})
            size += len(media)
            if size >= self.batch_bytes:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        source.close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def fetch(self, archive: str, member: zipfile.ZipInfo) -> bytes:
        """One member of an archive by its offset."""
        source = _Retried(archive, self.retries)
        try:
            return source.do(lambda f: fetch(f, member))
        finally:
            source.close()


class _Retried:
    """A file that stays open over many reads; after a read that fails it is opened anew and read again at the same offset."""

    def __init__(self, uri: str, retries: int):
        self.uri, self.retries, self.file = uri, retries, None

    def do(self, read):
        for left in range(self.retries, -1, -1):
            try:
                self.file = self.file or store.open_file(self.uri)
                return read(self.file)
            except OSError:
                self.close()
                if not left:
                    raise
        raise AssertionError

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


def directory_begin(f) -> int:
    """Where the directory of an archive begins, from the record at its end; no entry is read."""
    tail_size = min(f.size(), 22 + (1 << 16) + 20)
    base = f.size() - tail_size
    tail = f.read_at(tail_size, base)
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise OSError("no end of a ZIP directory")
    size, begin = struct.unpack_from("<II", tail, at + 12)
    if begin == 0xFFFFFFFF and tail[at - 20 : at - 16] == b"PK\6\7":  # the 64-bit form's record, found by its locator
        record = f.read_at(56, struct.unpack_from("<Q", tail, at - 12)[0])
        begin = struct.unpack_from("<Q", record, 48)[0]
    return begin


def members_of(f, partition: ByteRange) -> list[zipfile.ZipInfo]:
    """The members that begin in a range, from their entries or else from the whole directory."""
    if not partition.dir_end:
        with zipfile.ZipFile(f) as directory:
            return [m for m in directory.infolist() if partition.begin <= m.header_offset < partition.end]
    data = f.read_at(partition.dir_end - partition.dir_begin, partition.dir_begin)
    found, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"PK\1\2" or at + _ENTRY.size > len(data):
            raise OSError(f"no directory entry at {partition.dir_begin + at} of {partition.archive}")
        _, _, _, flags, method, _, _, crc, stored, size, n_name, n_extra, n_comment, _, _, _, offset = _ENTRY.unpack_from(data, at)
        name = data[at + _ENTRY.size : at + _ENTRY.size + n_name]
        m = zipfile.ZipInfo(name.decode("utf-8" if flags & 0x800 else "cp437"))
        m.compress_type, m.CRC, m.compress_size, m.file_size, m.header_offset = method, crc, stored, size, offset
        found.append(m)
        at += _ENTRY.size + n_name + n_extra + n_comment
    return found


def fetch(f, member: zipfile.ZipInfo) -> bytes:
    """One member by its offset; OSError if it isn't whole."""
    head = f.read_at(30, member.header_offset)
    if head[:4] != b"PK\x03\x04" or member.compress_type != zipfile.ZIP_STORED:
        raise OSError(f"no stored member at {member.header_offset}")
    begin = member.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
    data = f.read_at(member.file_size, begin)
    if len(data) != member.file_size or zlib.crc32(data) != member.CRC:
        raise OSError(f"the member at {member.header_offset} fails its checksum")
    return data


def read_archives(spark: SparkSession, where: str, **options) -> DataFrame:
    """The members of the archives that the manifest of ``where`` names, as (archive, member, offset, media)."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format(FORMAT).options(manifest=f"{where}/manifest", **{k: str(v) for k, v in options.items()}).load()


def feature(samples: bytes) -> str:
    """Sum, sum of squares, largest sample and number of line-to-line changes of the first column, as text."""
    a = np.frombuffer(samples, np.uint8).astype(np.int64)
    return f"{int(a.sum())}:{int((a * a).sum())}:{int(a.max())}:{int(np.count_nonzero(np.diff(a[::WIDTH])))}"


def features(members: DataFrame) -> DataFrame:
    """Sizes, checksums and features of stored images.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature. All but the first follow from the
    stored bytes alone; doc_id is the member's name, null if that is no number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for member, media in zip(batch.column("member").to_pylist(), batch.column("media").to_pylist()):
                payload, n_bytes = decode_image(media)
                stem = member.rpartition("/")[2].rpartition(".")[0]
                rows.append(
                    {
                        "doc_id": int(stem) if stem.lstrip("-").isdigit() else None,
                        "n_bytes": n_bytes,
                        "payload_bytes": len(payload),
                        "payload_sha256": hashlib.sha256(payload).hexdigest(),
                        "tail_crc32": zlib.crc32(payload[-WIDTH:]),
                        "media_bytes": len(media),
                        "media_sha256": hashlib.sha256(media).hexdigest(),
                        "feature": feature(payload),
                    }
                )
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]))

    bound_batches(members.sparkSession)
    return members.select("member", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
