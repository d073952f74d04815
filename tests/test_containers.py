import hashlib
import struct
import zlib

from mediasieve.functions import containers as C
from mediasieve.operators.clean import clean_bytes, picture_hash
from mediasieve.operators.records import describe


def seg(marker, payload):
    return bytes([0xFF, marker]) + struct.pack(">H", len(payload) + 2) + payload


def jpeg(*segments, tail=b"\x01\x02\xff\xd9"):
    return b"\xff\xd8" + b"".join(segments) + seg(0xDA, b"\1\1\0\0\x3f\0") + tail


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(*chunks):
    return C.PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 40, 30, 8, 2, 0, 0, 0)) + b"".join(chunks) + chunk(b"IDAT", b"pixels") + chunk(b"IEND", b"")


def riff(kind, data):
    return kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def webp(*chunks):
    body = b"".join(chunks)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def box(kind, data):
    return struct.pack(">I", 8 + len(data)) + kind + data


EXIF = b"Exif\0\0II*\0\x08\0\0\0\x01\0\x0f\x01\x02\0\x09\0\0\0\x1a\0\0\0\0\0\0\0TestMake\0"


def labels(data):
    return [r["label"] for r in describe("p", data)["records"] if r["label"]]


def test_jpeg_is_cleaned_without_touching_the_scan():
    data = jpeg(seg(0xE0, b"JFIF\0"), seg(0xE1, EXIF), seg(0xFE, b"hello"), seg(0xDB, b"q" * 64))
    assert labels(data) == ["APP1 (EXIF / XMP)", "COM (comment)"]
    out, notes, _, _ = clean_bytes(data)
    assert labels(out) == [] and notes == []
    assert picture_hash(out) == picture_hash(data) and out.endswith(data[data.index(b"\xff\xda") :])
    assert b"JFIF" in out and b"q" * 64 in out
    assert clean_bytes(out)[0] == out


def test_adobe_segment_is_noted_or_kept():
    data = jpeg(seg(0xEE, b"Adobe\0\0"))
    assert any("Adobe" in n for n in clean_bytes(data)[1])
    assert clean_bytes(data, keep_adobe=True)[0] == data


def test_bytes_after_the_scan_survive_and_are_seen():
    data = jpeg(tail=b"\x01\xff\xd9c2pa")
    assert clean_bytes(data)[0] == data
    assert describe("p", data)["signature_counts"][0] == 1


def test_png_text_goes_and_the_picture_stays():
    data = png(chunk(b"tEXt", b"Comment\0generated by a test"), chunk(b"zTXt", b"k\0\0" + zlib.compress(b"deep")), chunk(b"iTXt", b"i\0\0\0\0\0text"))
    row = describe("p", data)
    assert dict(row["text_kv"]) == {"Comment": "generated by a test", "k": "deep", "i": "text"}
    assert (row["width"], row["height"]) == (40, 30)
    assert row["records"][1]["detail"] == "generated by a test Comment"
    out = clean_bytes(data)[0]
    assert out == png() and picture_hash(out) == picture_hash(data)


def test_png_without_end_and_with_a_cut_chunk():
    whole = png(chunk(b"tEXt", b"a\0b"))
    assert labels(whole[:-12]) == ["tEXt chunk (text)"]
    cut = C.PNG_SIGNATURE + chunk(b"tIME", b"1234567") + struct.pack(">I", 1000) + b"tEXtshort"
    assert labels(cut) == ["tIME chunk (timestamp)"]


def test_webp_flags_sizes_and_padding():
    data = webp(riff(b"VP8X", bytes([0x2C, 0, 0, 0, 35, 0, 0, 27, 0, 0])), riff(b"ICCP", b"x" * 5), riff(b"VP8L", b"\x2fabcd"), riff(b"EXIF", b"e" * 7), riff(b"XMP ", b"m"))
    row = describe("p", data)
    assert [(r["label"], r["length"]) for r in row["records"] if r["label"]] == [("ICCP chunk", 13), ("EXIF chunk", 15), ("XMP  chunk", 9)]
    assert (row["width"], row["height"]) == (36, 28)
    out = clean_bytes(data)[0]
    assert out == webp(riff(b"VP8X", bytes([0, 0, 0, 0, 35, 0, 0, 27, 0, 0])), riff(b"VP8L", b"\x2fabcd"))


def test_iso_boxes_of_all_sizes():
    large = struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", 20) + b"data"
    data = box(b"ftyp", b"isom") + box(b"moov", box(b"udta", b"name") + box(b"meta", b"\0\0\0\0" + box(b"ilst", b""))) + large + struct.pack(">I", 0) + b"freetail"
    found = [(r.rtype, r.depth, r.length) for r in C.iso_records(data)]
    assert found == [("ftyp", 0, 12), ("moov", 0, 40), ("udta", 1, 12), ("meta", 1, 20), ("ilst", 2, 8), ("mdat", 0, 20), ("free", 0, 12)]
    out, _, boxes, _ = clean_bytes(data)
    assert len(out) == len(data) and boxes == 1 and b"name" not in out
    bad = box(b"ftyp", b"isom") + box(b"moov", struct.pack(">I", 4) + b"udta") + box(b"uuid", b"u" * 16)
    assert [r.rtype for r in C.iso_records(bad)] == ["ftyp", "moov", "uuid"]


def test_compressor_name_is_blanked():
    data = box(b"ftyp", b"isom") + box(b"moov", box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", box(b"stsd", bytes(8) + b"\x0cLavc libx264" + bytes(40)))))))
    out, _, _, names = clean_bytes(data)
    assert names == 1 and b"Lavc" not in out and len(out) == len(data)


def test_damaged_and_foreign_bytes_make_rows_not_errors():
    for data in (b"", b"\xff\xd8", b"\xff\xd8\xff\xe1\0\1", b"\xff\xd8\xff\xe1", C.PNG_SIGNATURE, b"RIFF0000WEBP", b"\0\0\0\x08ftyp", b"GIF89a" + bytes(9)):
        row = describe("p", data)
        assert row["error"] is None and labels(data) == []
    assert describe("p", None)["error"] == "unreadable"
    assert clean_bytes(b"GIF89a")[0] is None
    assert describe("a.png", jpeg(seg(0xFE, b"x")))["container"] == "jpeg"


def test_kept_and_dropped_ranges_cover_the_file():
    data = png(chunk(b"tEXt", b"a\0b"))
    assert 8 + sum(r.length for r in C.png_records(data)) == len(data)
    assert hashlib.sha256(data).digest()


def test_compressor_name_in_a_whole_sample_entry():
    """The fixed field of the entry, though the text occurs before it as well; 64-bit sizes stay."""
    entry = lambda name: box(b"avc1", bytes(42) + bytes([len(name)]) + name.ljust(31, b"\0") + b"\0\x18\xff\xff" + box(b"avcC", b"x264 settings"))
    body = bytes(4) + struct.pack(">I", 2) + entry(b"other") + entry(b"Lavc59 libx264")
    data = box(b"ftyp", b"isom") + box(b"moov", box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", box(b"stsd", body))))))
    out, _, boxes, names = clean_bytes(data)
    assert (boxes, names, len(out)) == (0, 1, len(data))
    assert out == data.replace(bytes([14]) + b"Lavc59 libx264".ljust(31, b"\0"), bytes(32))
