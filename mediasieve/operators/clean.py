"""Lossless cleaning: metadata records go, coded pictures stay byte for byte."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasieve.functions import containers as C
from mediasieve.functions.dictionaries import PNG_KEEP, SIGNATURES, WEBP_META
from mediasieve.functions.views import FileView, windows
from mediasieve.operators.findings import with_findings
from mediasieve.operators.records import describe, walk_files
from mediasieve.sources.shared import opened

MODES = {
    "jpeg": "lossless (JPEG segments rewritten)",
    "png": "lossless (PNG chunks rewritten)",
    "webp": "lossless (WebP chunks rewritten)",
    "iso": "in place (ISO boxes blanked)",
}
_LABEL = pa.struct([("kind", pa.string()), ("label", pa.string()), ("detail", pa.string())])
_CLEANED = pa.schema([("path", pa.string()), ("cleaned", pa.binary()), ("before", pa.int64()), ("after", pa.int64()), ("mode", pa.string()), ("notes", pa.list_(pa.string())), ("picture_before", pa.string()), ("picture_after", pa.string()), ("boxes", pa.int64()), ("names", pa.int64()), ("n_before", pa.int64()), ("removed", pa.list_(_LABEL)), ("left", pa.list_(pa.string())), ("same_size", pa.bool_()), ("declares_watermark", pa.bool_()), ("error", pa.string())])
_CLEANED_SQL = "path string, cleaned binary, before long, after long, mode string, notes array<string>, picture_before string, picture_after string, boxes long, names long, n_before long, removed array<struct<kind:string,label:string,detail:string>>, left array<string>, same_size boolean, declares_watermark boolean, error string"


def keeps(container: str, rtype: str, keep_adobe: bool = False) -> bool:
    if container == "jpeg":
        return not rtype.startswith("APP") and rtype != "COM" or rtype == "APP0" or keep_adobe and rtype == "APP14"
    return rtype in PNG_KEEP if container == "png" else rtype not in WEBP_META


def picture_hash(data: C.Data) -> str | None:
    """SHA-256 of the coded picture: a JPEG from its scan on, joined IDAT payloads, WebP image chunks, mdat payloads."""
    container = C.sniff(data)
    if container not in C.WALKERS:
        return None
    h = hashlib.sha256()
    for r in C.WALKERS[container](data):
        if r.rtype in ("SOS", "IDAT", "VP8 ", "VP8L", "ANMF", "ALPH", "mdat"):
            for window in windows(data, r.offset + r.header, min(r.offset + r.length, len(data)) - (4 if container == "png" else 0)):
                h.update(window)
    return h.hexdigest()


def clean_pieces(data: C.Data, keep_adobe: bool = False) -> tuple[list[C.Piece] | None, list[str], int, int]:
    """The cleaned file as ranges of the input and new bytes, notes, and the numbers of blanked boxes and names; None if the container isn't supported."""
    container, notes = C.sniff(data), []
    if container not in C.WALKERS:
        return None, ["unsupported container, not re-encoded"], 0, 0
    records = list(C.WALKERS[container](data))
    if container == "iso":
        patches = C.blanks(data, records)
        kinds = [kind for kind, *_ in patches]
        return C.patched(len(data), patches), notes, kinds.count("box"), kinds.count("name")
    kept = [r for r in records if keeps(container, r.rtype, keep_adobe)]
    for name, note in (("iCCP", "dropped ICC profile"), ("ICCP", "dropped ICC profile"), ("APP14", "dropped Adobe segment, which can change decoded colours"), ("acTL", "dropped animation")):
        if any(r.rtype == name for r in records) and not any(r.rtype == name for r in kept):
            notes.append(note)
    if container != "webp":
        return [C.Piece(2 if container == "jpeg" else 8, 0), *C.kept_ranges(kept)], notes, 0, 0
    body = [p._replace(length=min(p.length, len(data) - p.offset)) for p in C.kept_ranges(kept, padded=True)]
    for r in kept:
        if r.rtype == "VP8X" and r.length > 8:
            body = [q for p in body for q in _patched_byte(p, r.offset + 8, bytes([data[r.offset + 8] & 0xD3]))]  # ICC, EXIF and XMP flags
    size = 4 + sum(p.length for p in body)
    return [C.Piece(12, new=b"RIFF" + size.to_bytes(4, "little") + b"WEBP"), *body], notes, 0, 0


def _patched_byte(piece: C.Piece, at: int, new: bytes) -> list[C.Piece]:
    """A range of the input with one byte replaced, if that is in it."""
    if piece.offset is None or not piece.offset <= at < piece.offset + piece.length:
        return [piece]
    parts = [C.Piece(at - piece.offset, piece.offset), C.Piece(1, new=new), C.Piece(piece.offset + piece.length - at - 1, at + 1)]
    return [p for p in parts if p.length]


def clean_bytes(data: bytes, keep_adobe: bool = False) -> tuple[bytes | None, list[str], int, int]:
    """``clean_pieces`` put together in memory."""
    pieces, notes, boxes, names = clean_pieces(data, keep_adobe)
    return None if pieces is None else b"".join(C.assembled(data, pieces)), notes, boxes, names


def _labels(walked: dict) -> list[str]:
    """Labels of a walked row's findings, without signatures."""
    return [r["label"] for r in walked["records"] if r["label"]] + [f"info: {i['key']}" for i in walked["info"]]


def _found(walked: dict) -> list[tuple[str, str, str]]:
    """(kind, label, detail) of a walked row's findings."""
    records = [(r["kind"], r["label"], r["detail"]) for r in walked["records"] if r["label"]]
    info = [("info", f"info: {i['key']}", "") for i in walked["info"]]
    signatures = [("signature", label, f"{n} occurrence(s) of '{s}'") for n, (s, label) in zip(walked["signature_counts"], SIGNATURES) if n]
    return records + info + signatures


def _removed(old: dict, new: dict) -> list[dict]:
    """Findings of the input that the output no longer has."""
    left = set(_found(new))
    return [dict(zip(("kind", "label", "detail"), f)) for f in _found(old) if f not in left]


def _declares_watermark(walked: dict) -> bool:
    """Whether a finding of a walked row names a pixel watermark, which cleaning does not remove."""
    texts = [r["label"] + r["detail"] for r in walked["records"] if r["label"]] + [label for n, (_, label) in zip(walked["signature_counts"], SIGNATURES) if n]
    return any("synthid" in t.lower() for t in texts)


def clean(media: DataFrame, keep_adobe: bool = False, with_bytes: bool = True) -> DataFrame:
    """One row for each of ``media(path, content)``: cleaned bytes, sizes, mode, notes and picture hashes on both sides.

    Bytes are spliced in the task that read them, never shuffled; without
    ``with_bytes`` they end there. Unsupported containers have no cleaned bytes;
    failures become an error text. ``declares_watermark`` marks files whose
    metadata names a pixel watermark: that stays in the picture.
    """

    def one(path: str, data: bytes | None) -> dict:
        row = dict.fromkeys(_CLEANED.names) | {"path": path, "notes": [], "boxes": 0, "names": 0, "removed": [], "left": []}
        if data is None:
            return row | {"error": "unreadable"}
        try:
            out, notes, boxes, names = clean_bytes(data, keep_adobe)
        except (ValueError, IndexError) as e:
            return row | {"before": len(data), "error": f"{type(e).__name__}: {e}"}
        row |= {"before": len(data), "notes": notes, "mode": MODES.get(C.sniff(data), "unsupported"), "boxes": boxes, "names": names}
        old = describe(path, data)
        row["declares_watermark"] = _declares_watermark(old)
        row["n_before"] = len(_labels(old)) + sum(c > 0 for c in old["signature_counts"])
        if out is None:
            return row
        new = describe(path, out)
        same = (old["width"], old["height"]) == (new["width"], new["height"])
        return row | {"cleaned": out if with_bytes else None, "after": len(out), "picture_before": picture_hash(data), "picture_after": picture_hash(out), "removed": _removed(old, new), "left": _labels(new), "same_size": same}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 16):
                some = batch.slice(k, 16)
                yield pa.RecordBatch.from_pylist([one(p, c) for p, c in zip(some.column("path").to_pylist(), some.column("content").to_pylist())], _CLEANED)

    return media.select("path", "content").mapInArrow(run, _CLEANED_SQL)


_PLANNED = pa.schema([("path", pa.string()), ("pieces", pa.list_(pa.struct([("length", pa.int64()), ("offset", pa.int64()), ("new", pa.binary())]))), ("before", pa.int64()), ("after", pa.int64()), ("mode", pa.string()), ("notes", pa.list_(pa.string())), ("boxes", pa.int64()), ("names", pa.int64()), ("error", pa.string())])
_PLANNED_SQL = "path string, pieces array<struct<length:long,offset:long,new:binary>>, before long, after long, mode string, notes array<string>, boxes long, names long, error string"


def plan_files(listed: DataFrame, keep_adobe: bool = False) -> DataFrame:
    """How each file of ``listed(path)`` is cleaned: the output as ranges of the input and the few bytes that are new.

    Files are opened by URI in the tasks and only their headers are read, so
    plans are small and files may have any size. ``sources.pieces.publish``
    carries plans out. Unsupported containers have no pieces; failures become
    an error text.
    """

    def one(path: str) -> dict:
        row = dict.fromkeys(_PLANNED.names) | {"path": path, "notes": [], "boxes": 0, "names": 0}
        try:
            with opened(path) as f:
                data = FileView(f, f.size())
                pieces, notes, boxes, names = clean_pieces(data, keep_adobe)
                row |= {"before": len(data), "mode": MODES.get(C.sniff(data), "unsupported"), "notes": notes, "boxes": boxes, "names": names}
        except (ValueError, IndexError, OSError) as e:
            return row | {"error": f"{type(e).__name__}: {e}"}
        return row if pieces is None else row | {"pieces": [p._asdict() for p in pieces], "after": sum(p.length for p in pieces)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 64):
                yield pa.RecordBatch.from_pylist([one(p) for p in batch.column("path")[k : k + 64].to_pylist()], _PLANNED)

    return listed.select("path").mapInArrow(run, _PLANNED_SQL)


def hash_files(listed: DataFrame) -> DataFrame:
    """(path, length, picture): size and picture hash of each file of ``listed(path)``, read in windows; null where it can't be read."""

    def one(path: str) -> dict:
        try:
            with opened(path) as f:
                data = FileView(f, f.size())
                return {"path": path, "length": len(data), "picture": picture_hash(data)}
        except (ValueError, IndexError, OSError):
            return {"path": path, "length": None, "picture": None}

    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("picture", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([one(p) for p in batch.column("path").to_pylist()], schema)

    return listed.select("path").mapInArrow(run, "path string, length long, picture string")


def verify(media: DataFrame, keep_adobe: bool = False) -> DataFrame:
    """``clean`` without the bytes: path, before, after, mode, notes, same_picture, same_size, left, n_before, n_left, boxes, names, declares_watermark, error.

    ``left`` are the findings of the output without raw signature hits, which
    may lie in the picture itself. Both sides are inspected in the task that
    cleaned them.
    """
    return clean(media, keep_adobe, with_bytes=False).select(
        "path", "before", "after", "mode", "notes", (F.col("picture_before") == F.col("picture_after")).alias("same_picture"), "same_size", "left", "n_before", F.size("left").cast("long").alias("n_left"), "boxes", "names", "declares_watermark", "error"
    )


def removed(media: DataFrame, keep_adobe: bool = False) -> DataFrame:
    """(path, kind, label, detail) of findings that cleaning takes away; both sides are inspected in the task that cleans."""
    return clean(media, keep_adobe, with_bytes=False).select("path", F.explode("removed").alias("f")).select("path", "f.*")


def removed_between(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, kind, label, detail) of findings of files that their cleaned copies no longer have.

    ``before(path, key)`` and ``after(path, key)`` are listed files of any size;
    both are walked by ranges, and only their findings are joined. A file
    without a copy has no removals.
    """
    side = lambda files, name: with_findings(walk_files(files.select("path", key), keep=(key,))).select(key, F.transform("findings", lambda f: F.struct(f.kind.alias("kind"), f.label.alias("label"), f.detail.alias("detail"))).alias(name))
    both = side(before, "old").join(side(after, "left"), key)
    gone = F.filter("old", lambda f: ~F.array_contains("left", f))
    return both.select(key, F.explode(gone).alias("f")).select(key, "f.*")
