"""Listing, walking and cleaning files by path, the publishing sink, and the grid job."""

import json
import os
import random
import re
import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mediasieve.functions import containers as C
from mediasieve.functions.dictionaries import READABLE
from mediasieve.functions.views import Counter, FileView, longest_runs
from mediasieve.jobs import grids, reports
from mediasieve.operators import clean, grid
from mediasieve.operators.records import describe, describe_file, walk, walk_files
from mediasieve.sources import fixtures as X
from mediasieve.sources import pieces
from mediasieve.sources.listing import list_all, list_files, list_unsupported
from mediasieve.sources.media import scan
from mediasieve.sources.pieces import PieceWriter, publish

SF = "/root/testdata/sf0.001"


def box(kind, payload=b""):
    return struct.pack(">I4s", 8 + len(payload), kind) + payload


# --- windows -------------------------------------------------------------------


def test_counts_and_runs_do_not_depend_on_windows(tmp_path):
    rnd = random.Random(1)
    data = b"".join(rnd.choice([b"aa", b"a", b"Jumb", b"ju", b"mb", b"\0", b"c2pa", b"readable run ", b"\xff"]) for _ in range(4000))
    strings = [b"aa", b"aaa", b"jumb", b"c2pa", b"mbju"]
    whole = [data.lower().count(s) for s in strings]
    for size in (1, 2, 3, 7, 1000, len(data)):
        counter = Counter(strings)
        for at in range(0, len(data), size):
            counter.add(data[at : at + size])
        assert counter.counts == whole
    (tmp_path / "f").write_bytes(data)
    plain = sorted(re.findall(READABLE + "{4,}", data[5:-5].decode("latin-1")), key=len, reverse=True)
    for block in (1, 5, 64, 1 << 20):
        view = FileView(open(tmp_path / "f", "rb"), len(data), block)
        assert [view[k] for k in (0, 5, len(data) - 1)] == [data[0], data[5], data[-1]]
        assert view[10:500] == data[10:500] and view[-3:] == data[-3:] and view[9:3] == b""
    import mediasieve.functions.views as V

    old = V.windows.__defaults__
    try:
        for size in (1, 3, 50, 1 << 20):
            V.windows.__defaults__ = (0, None, size)
            assert longest_runs(data, 5, len(data) - 5, 4, 6) == plain[:6]
    finally:
        V.windows.__defaults__ = old


# --- listing -------------------------------------------------------------------


def test_listing_equals_a_plain_walk(spark, tmp_path):
    names = ["_DSC0001.JPG", "a.jpg", ".skipped.png", ".hid/b.PNG", "_x/y/c.webp", "_x/y/z/d.mov", "x/e.txt", "x/no", "x/%41 é.mp4", "deep/1/2/3/4/f.m4v", "_only.txt"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(n.encode())
    os.mkfifo(tmp_path / "x" / "pipe.png")
    (tmp_path / "empty").mkdir()
    for fan_out in (1, 2, 3, 100):
        rows = list_all(spark, f"file://{tmp_path}", fan_out).collect()
        assert sorted(r.rel_path for r in rows if r.error is None) == sorted(n for n in names if not n.split("/")[-1].startswith("."))
        assert all(r.length == len(r.rel_path.encode()) for r in rows if r.error is None)
        assert [r.rel_path for r in rows if r.error] == ["x/pipe.png"]
    supported = {r.rel_path: r.kind for r in list_files(spark, f"file://{tmp_path}").where("error IS NULL").collect()}
    assert supported == {"_DSC0001.JPG": "image", "a.jpg": "image", ".hid/b.PNG": "image", "_x/y/c.webp": "image", "_x/y/z/d.mov": "video", "x/%41 é.mp4": "video", "deep/1/2/3/4/f.m4v": "video"}
    assert sorted(r.rel_path for r in list_unsupported(spark, f"file://{tmp_path}").collect()) == ["_only.txt", "x/e.txt", "x/no"]
    missing = list_all(spark, f"file://{tmp_path}/nothing").collect()
    assert len(missing) == 1 and missing[0].error.startswith("folder not listed")
    assert list_all(spark, f"file://{tmp_path}/empty").count() == 0


def test_files_by_path_are_walked_and_judged_as_in_memory(spark, tmp_path):
    media = X.media(spark, SF).withColumn("rel_path", F.concat_ws("/", "media_id", "rel_path")).cache()
    publish(media.select("path", F.col("rel_path").alias("out_path"), "content"), f"file://{tmp_path}/in")
    files = list_files(spark, f"file://{tmp_path}/in")
    plain = lambda df: {r.path.split("/in/")[-1].removeprefix("/media/").split("/")[0]: tuple(r)[1:] for r in df.collect()}
    assert plain(walk_files(files)) == plain(walk(media))
    assert plain(reports.audit_files(files).drop("rel_path")) == plain(reports.audit(media).drop("rel_path"))
    gone = files.select(F.concat("path", F.lit(".gone")).alias("path")).limit(2)
    assert all(r.error.startswith("unreadable") for r in walk_files(gone).collect())


def test_scan_takes_contents_up_to_a_size(spark, tmp_path):
    (tmp_path / "_a.png").write_bytes(b"12345")
    (tmp_path / "b.mp4").write_bytes(b"1234567890")
    (tmp_path / "c.txt").write_bytes(b"no")
    got = {r.rel_path: (r.kind, r.length, r.content and bytes(r.content)) for r in scan(spark, str(tmp_path), max_bytes=6).collect()}
    assert got == {"_a.png": ("image", 5, b"12345"), "b.mp4": ("video", 10, None)}
    assert [r.error for r in walk(scan(spark, str(tmp_path), max_bytes=6)).orderBy("path").collect()] == [None, "unreadable"]


def test_files_over_two_gigabytes_are_walked_and_planned_in_little_memory(tmp_path):
    path = tmp_path / "_big.mp4"
    big = 3 << 30
    with open(path, "wb") as f:
        f.write(box(b"ftyp", b"isom\0\0\2\0isomiso2") + struct.pack(">I4sQ", 1, b"mdat", big))
        f.seek(big - 16 - 40, 1)
        f.write(b"trainedAlgorithmicMedia".ljust(40))
        f.write(box(b"moov", box(b"udta", b"Some name")) + box(b"uuid", bytes.fromhex("be7acfcb97a942e89c71999491e3afac") + b"readable text here"))
    tracemalloc.start()
    row = describe_file(f"file://{path}")
    plan = clean.clean_pieces(FileView(open(path, "rb"), path.stat().st_size))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    assert [r["rtype"] for r in row["records"]] == ["ftyp", "mdat", "moov", "udta", "uuid"]
    assert row["records"][-1]["detail"] == "readable text here" and row["error"] is None
    assert row["signature_counts"][3] == 1 and not row["says_generated"]  # beyond the bytes that are read for declarations
    pieces, _, boxes, _ = plan
    assert boxes == 2 and sum(p.length for p in pieces) == path.stat().st_size and len(pieces) < 9


# --- cleaning by pieces and the sink ---------------------------------------------


def test_published_pieces_equal_cleaning_in_memory(spark, tmp_path):
    media = X.media(spark, SF).withColumn("out_path", F.concat_ws("/", "media_id", "rel_path")).cache()
    publish(media.select("path", "out_path", "content"), f"file://{tmp_path}/in")
    files = list_files(spark, f"file://{tmp_path}/in")
    plans = clean.plan_files(files).join(files.select("path", F.col("rel_path").alias("out_path")), "path")
    done = publish(plans, f"file://{tmp_path}/out").collect()
    want = {r.out_path: clean.clean_bytes(bytes(r.content))[0] for r in media.collect()}
    assert {r.out_path: r.written for r in done} == {k: len(v) for k, v in want.items()}
    assert {k: (tmp_path / "out" / k).read_bytes() for k in want} == want
    assert sorted(os.listdir(tmp_path / "out")) == sorted({k.split("/")[0] for k in want})


def test_padded_and_cut_webp_chunks_by_pieces():
    riff = lambda kind, data: kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    for tail in (b"", riff(b"VP8 ", b"abc")[:-1], riff(b"EXIF", b"x"), riff(b"odd ", b"12345") + riff(b"XMP ", b"y")):
        data = b"RIFF\0\0\0\0WEBP" + riff(b"VP8X", b"\x2c" + bytes(9)) + riff(b"VP8 ", b"123") + tail
        out = clean.clean_bytes(data)[0]
        assert int.from_bytes(out[4:8], "little") == len(out) - 8 and out[20] == 0
        assert clean.clean_bytes(out)[0] == out and b"EXIF" not in out and b"XMP " not in out


def test_sink_refuses_and_reports(spark, tmp_path):
    rows = [("a", "ok/1", b"one", None), ("b", "ok/1", b"two", None), ("c", "../out", b"x", None), ("d", "/abs", b"x", None), ("e", None, b"x", None), ("f", "ok/2", None, None), ("g", "ok/3", None, "unreadable"), ("h", "ok/4", b"", None)]
    df = spark.createDataFrame(rows, "path string, out_path string, content binary, error string").repartition(3)
    got = {r.path: (r.written, r.error) for r in publish(df, f"file://{tmp_path}").collect()}
    assert got == {"a": (3, None), "b": (None, "output path is taken"), "c": (None, "path escapes the output folder"), "d": (None, "path escapes the output folder"), "e": (None, "path escapes the output folder"), "f": (None, "nothing to write"), "g": (None, "unreadable"), "h": (0, None)}
    assert sorted(os.listdir(tmp_path)) == ["ok"] and sorted(os.listdir(tmp_path / "ok")) == ["1", "4"]
    missing = spark.createDataFrame([(f"file://{tmp_path}/none", "x", [(1, 0, None)])], "path string, out_path string, pieces array<struct<length:long,offset:long,new:binary>>")
    assert publish(missing, f"file://{tmp_path}").first().error.startswith("FileNotFoundError")


def batch(*rows):
    names = ("path", "out_path", "pieces", "content", "error", "tag")
    return pa.RecordBatch.from_pylist([dict(zip(names, (p, o, None, c, None, None))) for p, o, c in rows], pa.schema([("path", pa.string()), ("out_path", pa.string()), ("pieces", pa.list_(pa.struct([("length", pa.int64()), ("offset", pa.int64()), ("new", pa.binary())]))), ("content", pa.binary()), ("error", pa.string()), ("tag", pa.string())]))


def test_failed_and_lost_attempts_leave_nothing(tmp_path):
    writer = PieceWriter(f"file://{tmp_path}/out", f"file://{tmp_path}/report", "job")

    def failing():
        yield batch(("a", "x/a", b"first"))
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        writer.write(failing())
    lost = writer.write(iter([batch(("a", "x/a", b"lost attempt"))]))  # finished, but its message never arrived
    kept = writer.write(iter([batch(("a", "x/a", b"second"), ("b", "b", b"bb"))]))
    assert not (tmp_path / "out" / "x").exists()
    writer.commit([kept, None])
    assert lost.manifest != kept.manifest
    assert (tmp_path / "out/x/a").read_bytes() == b"second" and sorted(os.listdir(tmp_path / "out")) == ["b", "x"]
    other = PieceWriter(f"file://{tmp_path}/out", f"file://{tmp_path}/report2", "other")
    other.abort([other.write(iter([batch(("c", "c", b"c"))]))])
    assert sorted(os.listdir(tmp_path / "out")) == ["b", "x"] and not (tmp_path / "report2").exists()


def test_a_failing_job_publishes_nothing(spark, tmp_path):
    df = spark.range(20).select(F.col("id").cast("string").alias("path"), F.col("id").cast("string").alias("out_path"), F.when(F.col("id") == 13, F.raise_error(F.lit("lost"))).otherwise(F.lit(b"x")).cast("binary").alias("content")).repartition(4)
    with pytest.raises(Exception):
        publish(df, f"file://{tmp_path}")
    assert [n for n in os.listdir(tmp_path) if not n.startswith(".staging")] == []


# --- grids -------------------------------------------------------------------------


def picture(h, w, rows, cols, seed=0, border=3):
    rnd = np.random.default_rng(seed)
    a = rnd.integers(0, 200, (h, w, 3), dtype=np.uint8)
    a[:border], a[h - border :], a[:, :border], a[:, w - border :] = 255, 255, 255, 255
    if rows:
        a[rows[0] : rows[1]] = 255
    if cols:
        a[:, cols[0] : cols[1]] = 255
    return a


PICTURES = {
    "even": picture(120, 140, (57, 63), (66, 74)),
    "none": picture(100, 100, None, None, 1, 0),
    "thin": picture(90, 101, (44, 46), (49, 53), 2),
    "tiny": picture(34, 60, (14, 19), (28, 33), 3, 2),
    "white": np.full((40, 50, 3), 255, np.uint8),
    "far": picture(400, 300, (10, 20), (100, 110), 4),
}


@pytest.fixture(scope="module")
def pictures(spark):
    rows = [(k, f"in/{k}.png", a.shape[0], a.shape[1], a.tobytes()) for k, a in PICTURES.items()]
    return spark.createDataFrame(rows, "path string, rel_path string, height int, width int, rgb binary").repartition(3).cache()


def test_grid_plans_equal_the_tabular_form(spark, pictures):
    axes = grid.detect_axes(grid.as_lines(grid.line_profile(pictures)))
    table = {(r.image_id, r.panel_no): (r.left, r.upper, r.right, r.lower, r.row_fallback, r.col_fallback) for r in grid.large_enough(grid.panels(axes)).collect()}
    planned = grid.kept_panels(grid.plan_grids(pictures)).collect()
    assert {(r.path, r.panel_no): (r.left, r.upper, r.right, r.lower, r.row_fallback, r.col_fallback) for r in planned} == table
    cut = [(f"{r.path} {r.panel_no}", r.lower - r.upper, r.right - r.left, np.ascontiguousarray(PICTURES[r.path][r.upper : r.lower, r.left : r.right]).tobytes()) for r in planned]
    panels = spark.createDataFrame(cut, "path string, height int, width int, rgb binary")
    trims = {(r.image_id, r.axis): (r.low, r.high) for r in grid.trims(grid.as_lines(grid.line_profile(panels))).collect()}
    for r in planned:
        assert (r.trim_top, r.trim_bottom) == trims[f"{r.path} {r.panel_no}", 0]
        assert (r.trim_left, r.trim_right) == trims[f"{r.path} {r.panel_no}", 1]


def test_grid_job_numbers_kept_panels_and_writes_them(spark, pictures, tmp_path):
    videos = spark.createDataFrame([("in/f.mp4",)], "rel_path string")
    some = pictures.where("path IN ('even', 'tiny', 'thin')")
    done = grids.split_grids(some, f"file://{tmp_path}", videos, prefix="p", flag="45").orderBy("number").collect()
    assert [(r.path, r.panel_no, r.number) for r in done] == [("even", 1, 1), ("even", 2, 2), ("even", 3, 3), ("even", 4, 4)] + [("thin", k, k + 5) for k in (1, 2, 3, 4)]  # the video is number 5, tiny has no panel of 16 lines
    for r in done:
        data = (tmp_path / r.out_path).read_bytes()
        assert r.out_path == f"p{r.number}.png" and r.written == len(data) and r.error is None
        records = list(C.png_records(data))
        assert C.dimensions("png", data, records) == (1080, 1350) and [x.rtype for x in records] == ["IHDR", "IDAT", "IEND"]
    dry = grids.split_grids(pictures, f"file://{tmp_path}/dry", layout="mirror", dry_run=True).collect()
    assert not (tmp_path / "dry").exists() and all(r.number == r.panel_no and r.written is None for r in dry)
    assert {r.out_path for r in dry if r.path == "none"} == {f"in/none/panel{k}_{f}.png" for k in (1, 2, 3, 4) for f in ("45", "916")}
    assert grids.split_grids(pictures.limit(0), f"file://{tmp_path}").count() == 0


def test_describe_of_windows_equals_describe_of_bytes(tmp_path):
    for k, data in enumerate([b"", b"\xff\xd8", b"\x89PNG\r\n\x1a\n" + struct.pack(">I4s", 5, b"tEXt") + b"a\0bcd" + bytes(4), b"RIFF\1\0\0\0WEBPEXIF\xff\0\0\0II", box(b"ftyp", b"isom") + box(b"uuid", b"12")]):
        (tmp_path / str(k)).write_bytes(data)
        assert describe_file(f"file://{tmp_path}/{k}") | {"path": ""} == describe("", data)


def test_plans_go_to_pictures_and_no_pixel_moves(spark, monkeypatch):
    """However small Spark takes pictures for that are made from a small table, and however many plans there are."""
    from test_frames import moved_columns

    made = X.pictures(spark, SF)
    outputs = grids.plan_outputs(grids.number_outputs(grid.kept_panels(grid.plan_grids(made.withColumn("rel_path", F.col("path")), keep=("rel_path",)), "rel_path")), full_size=False)
    few = [tuple(r) for r in grids.cut_outputs(made, outputs).select("path", "out_path", "pixels_sha256").collect()]
    monkeypatch.setattr(grids, "_FEW", 0)
    many = grids.cut_outputs(made, outputs).select("path", "out_path", "pixels_sha256")
    assert not {"rgb", "content"} & moved_columns(many, "Exchange", "BroadcastExchange")
    assert few and sorted(few) == sorted(tuple(r) for r in many.collect())


def test_tasks_move_what_is_staged(spark, tmp_path):
    """The driver's commit leaves the drafts; moving them again after a lost attempt changes nothing, and drafts that are gone are an error."""
    root = f"file://{tmp_path}/out"
    writer = PieceWriter(root, f"file://{tmp_path}/report", "job", later=True)
    writer.commit([writer.write(iter([batch(("a", "x/a", b"one"), ("b", "../b", None), ("c", "c", b""))])), None])
    assert os.listdir(tmp_path / "out") == [".staging-job"]
    staged = [json.loads(x)["manifest"] for x in (tmp_path / "report/staged.jsonl").read_text().splitlines()]
    for _ in range(2):
        rows = [r for b in pieces._moved(root)(iter([pa.RecordBatch.from_pydict({"manifest": staged})])) for r in b.to_pylist()]
        assert [(r["path"], r["written"], r["error"]) for r in rows] == [("a", 3, None), ("b", None, "nothing to write"), ("c", 0, None)]
        assert (tmp_path / "out/x/a").read_bytes() == b"one" and (tmp_path / "out/c").read_bytes() == b""
    (tmp_path / "out/c").unlink()
    with pytest.raises(OSError):
        list(pieces._moved(root)(iter([pa.RecordBatch.from_pydict({"manifest": staged})])))


def test_names_alone_tell_which_paths_are_taken(spark, tmp_path):
    df = spark.createDataFrame([("a", "1", b"a"), ("b", "1", b"b"), ("c", "2", b"c")], "path string, out_path string, content binary")
    got = {r.path: (r.written, r.error) for r in publish(df, f"file://{tmp_path}", names=df.select("path", "out_path")).collect()}
    assert got == {"a": (1, None), "b": (None, "output path is taken"), "c": (1, None)}
    assert sorted(os.listdir(tmp_path)) == ["1", "2"]
