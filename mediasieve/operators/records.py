"""Table functions over file bytes: one pass that lists records and drops the bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasieve.functions import containers as C
from mediasieve.functions.dictionaries import DECLARATION_BYTES, ISO_FINDINGS, LEFTOVER_SIGNATURES, PNG_KEEP, PNG_META, SIGNATURES, UUID_LABELS, WEBP_META
from mediasieve.functions.views import Counter, FileView, longest_runs, windows
from mediasieve.sources.shared import opened

_RECORD = pa.struct([("seq", pa.int32()), ("rtype", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("header", pa.int32()), ("depth", pa.int32()), ("kind", pa.string()), ("label", pa.string()), ("detail", pa.string())])
WALKED = pa.schema(
    [
        ("path", pa.string()),
        ("container", pa.string()),
        ("length", pa.int64()),
        ("records", pa.list_(_RECORD)),
        ("info", pa.list_(pa.struct([("key", pa.string()), ("nbytes", pa.int64())]))),
        ("text_kv", pa.map_(pa.string(), pa.string())),
        ("exif", pa.map_(pa.int32(), pa.string())),
        ("width", pa.int32()),
        ("height", pa.int32()),
        ("signature_counts", pa.list_(pa.int32())),
        ("leftover_signatures", pa.list_(pa.string())),
        ("says_generated", pa.bool_()),
        ("says_composite", pa.bool_()),
        ("says_synthid", pa.bool_()),
        ("error", pa.string()),
    ]
)
WALKED_SQL = (
    "path string, container string, length long, records array<struct<seq:int,rtype:string,offset:long,length:long,header:int,depth:int,kind:string,label:string,detail:string>>, "
    "info array<struct<key:string,nbytes:long>>, text_kv map<string,string>, exif map<int,string>, width int, height int, signature_counts array<int>, leftover_signatures array<string>, "
    "says_generated boolean, says_composite boolean, says_synthid boolean, error string"
)


_DECLARATIONS = (b"trainedalgorithmicmedia", b"compositewithtrainedalgorithmicmedia", b"synthid")
#: All strings that are looked for in whole files.
_SWEPT = tuple(dict.fromkeys(s.encode() for s in (*(s for s, _ in SIGNATURES), *LEFTOVER_SIGNATURES)))


def _finding(container: str, r: C.Record, data: C.Data) -> tuple[str | None, str | None, str]:
    """Kind, label and detail of a record that is a finding."""
    start, end = r.offset + r.header, min(r.offset + r.length, len(data))
    if container == "jpeg":
        label = C.app_label(r.rtype)
        return ("segment", label, "") if label else (None, None, "")
    if container == "png":
        if r.rtype in PNG_META:
            return "chunk", f"{r.rtype} chunk ({PNG_META[r.rtype]})", " ".join(longest_runs(data, start, end - 4, 4, 2))
        return (None, None, "") if r.rtype in PNG_KEEP else ("chunk", f"{r.rtype} chunk", "")
    if container == "webp":
        return ("chunk", f"{r.rtype} chunk", "") if r.rtype in WEBP_META else (None, None, "")
    if r.rtype == "uuid":
        uid = data[start : min(start + 16, end)].hex()
        return "box", UUID_LABELS.get(uid, f"unknown uuid box ({uid[:16]})"), " | ".join(longest_runs(data, start + 16, end, 6, 3))
    return ("box", f"{r.rtype} box", "") if r.rtype in ISO_FINDINGS else (None, None, "")


def _info(container: str, records: list[C.Record], data: C.Data) -> list[dict]:
    """What an image library would show besides the picture, with sizes."""
    sizes: dict[str, int] = {}
    for r in records:
        start = r.offset + r.header
        end = min(r.offset + r.length - (4 if container == "png" else 0), len(data))
        begins = lambda prefix: data[start : min(start + len(prefix), end)] == prefix  # noqa: B023, E731
        key = {
            ("jpeg", "APP1"): lambda: "exif" if begins(b"Exif") else "xmp" if begins(b"http://ns.adobe.com/xap/") else None,
            ("jpeg", "APP2"): lambda: "icc_profile" if begins(b"ICC_PROFILE\0") else None,
            ("jpeg", "APP13"): lambda: "photoshop",
            ("jpeg", "APP14"): lambda: "adobe",
            ("jpeg", "COM"): lambda: "comment",
            ("png", "eXIf"): lambda: "exif",
            ("png", "iCCP"): lambda: "icc_profile",
            ("png", "iTXt"): lambda: "xmp" if begins(b"XML:com.adobe.xmp\0") else None,
            ("webp", "EXIF"): lambda: "exif",
            ("webp", "ICCP"): lambda: "icc_profile",
            ("webp", "XMP "): lambda: "xmp",
        }.get((container, r.rtype), lambda: None)()
        if key and end > start:
            sizes[key] = sizes.get(key, 0) + (0 if key in ("photoshop", "adobe") else end - start)
    return [{"key": k, "nbytes": sizes[k]} for k in ("exif", "icc_profile", "photoshop", "adobe", "comment", "xmp") if k in sizes]


def _sweep(data: C.Data) -> dict:
    """Signature counts, left-over signatures and declarations, from one pass in windows."""
    counts, said = Counter(_SWEPT), Counter(_DECLARATIONS)
    at = 0
    for window in windows(data):
        counts.add(window)
        if at < DECLARATION_BYTES:
            said.add(window[: DECLARATION_BYTES - at])
        at += len(window)
    number = dict(zip(_SWEPT, counts.counts))
    found = {"signature_counts": [number[s.encode()] for s, _ in SIGNATURES], "leftover_signatures": [s for s in LEFTOVER_SIGNATURES if number[s.encode()]]}
    return found | dict(zip(("says_generated", "says_composite", "says_synthid"), (n > 0 for n in said.counts)))


def describe(path: str, data: C.Data | None) -> dict:
    """The walked row of one file; what goes wrong becomes its error."""
    row: dict = {"path": path, "container": None, "length": None, "records": [], "info": [], "text_kv": [], "exif": [], "width": None, "height": None}
    row |= {"signature_counts": [0] * len(SIGNATURES), "leftover_signatures": [], "says_generated": False, "says_composite": False, "says_synthid": False, "error": None}
    if data is None:
        return row | {"error": "unreadable"}
    try:
        row |= {"container": C.sniff(data), "length": len(data)} | _sweep(data)
        records = list(C.WALKERS[row["container"]](data)) if row["container"] in C.WALKERS else []
        for seq, r in enumerate(records):
            kind, label, detail = _finding(row["container"], r, data)
            row["records"].append({"seq": seq, "rtype": r.rtype, "offset": r.offset, "length": r.length, "header": r.header, "depth": r.depth, "kind": kind, "label": label, "detail": detail})
        row["info"] = _info(row["container"], records, data)
        texts = {}
        for r in records:
            if row["container"] == "png" and r.rtype in ("tEXt", "zTXt", "iTXt"):
                try:
                    found = C.png_text(r.rtype, data[r.offset + 8 : r.offset + r.length - 4])
                except ValueError as e:  # the other records are good
                    row["error"] = f"{r.rtype} at {r.offset}: {e}"
                    continue
                if found:
                    texts[found[0]] = found
        row["text_kv"] = list(texts.values())
        row["exif"] = list(C.tiff_tags(C.exif_block(row["container"], data, records)).items())
        row["width"], row["height"] = C.dimensions(row["container"], data, records) or (None, None)
    except (ValueError, IndexError, OverflowError, OSError) as e:
        row["error"] = f"{type(e).__name__}: {e}"
    return row


def walk(media: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each of ``media(path, content)`` with its records, texts, tags, size and signature counts; bytes are dropped.

    Columns of ``media`` named by ``keep`` stay.

    A null content is an error row; a damaged file has the records up to the
    damage; no file stops the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 16):
                some = batch.slice(k, 16)
                out = pa.RecordBatch.from_pylist([describe(p, c) for p, c in zip(some.column("path").to_pylist(), some.column("content").to_pylist())], WALKED)
                for name in keep:
                    out = out.append_column(name, some.column(name))
                yield out

    kept = "".join(f", `{name}` {media.schema[name].dataType.simpleString()}" for name in keep)
    return media.select("path", "content", *keep).mapInArrow(run, WALKED_SQL + kept)


def describe_file(path: str) -> dict:
    """``describe`` of a file that is opened where the row is, and read by ranges."""
    try:
        with opened(path) as f:
            return describe(path, FileView(f, f.size()))
    except OSError as e:
        return describe(path, None) | {"error": f"unreadable: {e}"}


def walk_files(listed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``walk`` for files of any size, from their URIs alone: ``listed(path)``, as ``sources.listing.list_files`` gives it.

    Each task opens its files itself and holds a window of one file at a time;
    payloads of pictures and films are swept for signatures and otherwise
    skipped. A file that can't be opened or read is an error row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 16):
                some = batch.slice(k, 16)
                out = pa.RecordBatch.from_pylist([describe_file(p) for p in some.column("path").to_pylist()], WALKED)
                for name in keep:
                    out = out.append_column(name, some.column(name))
                yield out

    kept = "".join(f", `{name}` {listed.schema[name].dataType.simpleString()}" for name in keep)
    return listed.select("path", *keep).mapInArrow(run, WALKED_SQL + kept)


def sniff(content: Column) -> Column:
    """The container by magic bytes, in Spark expressions."""
    part = lambda a, n: F.hex(F.substring(content, a, n))
    return (
        F.when(part(1, 2) == "FFD8", "jpeg")
        .when(part(1, 8) == "89504E470D0A1A0A", "png")
        .when((part(1, 4) == b"RIFF".hex().upper()) & (part(9, 4) == b"WEBP".hex().upper()), "webp")
        .when((part(5, 4) == b"ftyp".hex().upper()) & (F.length(content) > 8), "iso")
        .otherwise("other")
    )
