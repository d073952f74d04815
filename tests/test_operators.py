import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_containers import EXIF, chunk, jpeg, png, seg

from mediasieve.jobs import reports
from mediasieve.operators import clean, frames, grid, naming, video
from mediasieve.sources import fixtures as X
from mediasieve.sources import media as M


def unique_dest(names):
    used, out = set(), []
    for name in names:
        base = name.rsplit("/", 1)[-1] or "upload"
        dot = base.rfind(".")
        stem, ext = (base[:dot], base[dot:]) if dot > 0 else (base, "")
        got, n = base, 1
        while got.lower() in used:
            got, n = f"{stem}_{n}{ext}", n + 1
        used.add(got.lower())
        out.append(got)
    return out


def test_unique_names_match_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    pool = ["shot.jpg", "SHOT.jpg", "shot_1.jpg", "shot_1_1.jpg", "shot_2.JPG", "a", "a_1", "", "x/", ".hid", "dir/shot.jpg", "b.png"]
    rows = [(b, k, str(rng.choice(pool))) for b in range(3) for k in range(40)]
    got = naming.unique_names(spark.createDataFrame(rows, "batch long, ord long, name string")).collect()
    for b in range(3):
        mine = sorted((r.ord, r.unique) for r in got if r.batch == b)
        assert [u for _, u in mine] == unique_dest([n for bb, _, n in rows if bb == b])


@pytest.mark.parametrize("seed", range(4))
def test_unique_names_where_real_names_look_generated(spark, seed):
    rng = np.random.default_rng(seed)
    pool = ["s.jpg"] * 6 + [f"s_{k}.jpg" for k in range(1, 13)] + [f"S_{k}_{j}.jpg" for k in (1, 2, 3) for j in (1, 2)] + ["s_01.jpg", "s_0.jpg", "_1.jpg", ".jpg", "s", "s_1", ".s_1", "s_1.", "s."]
    rows = [(0, k, str(rng.choice(pool))) for k in range(150)] + [(1, 1000 - k, str(rng.choice(pool))) for k in range(60)]
    got = naming.unique_names(spark.createDataFrame(rows, "batch long, ord long, name string").repartition(3)).collect()
    for b in (0, 1):
        mine = sorted((r.ord, r.unique) for r in got if r.batch == b)
        assert [u for _, u in mine] == unique_dest([n for _, _, n in sorted(r for r in rows if r[0] == b)])
    assert naming.unique_names(spark.createDataFrame([], "batch long, ord long, name string")).count() == 0


def test_numbers_run_over_all_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = naming.numbered(rows, "k", parts=7).collect()
    assert [r.number for r in sorted(got, key=lambda r: r.k)] == list(range(1, 1001))
    assert naming.numbered(rows.where("k < 0"), "k").count() == 0


def picture_rows(spark, *arrays):
    return spark.createDataFrame([(str(k), a.shape[0], a.shape[1], bytearray(a.tobytes())) for k, a in enumerate(arrays)], "path string, height int, width int, rgb binary")


def test_grid_without_a_gutter_is_halved(spark):
    a = np.zeros((200, 200, 3), np.uint8)
    a[:100, :100], a[:100, 100:], a[100:, :100], a[100:, 100:] = 40, 90, 140, 190
    got = grid.detect_axes(grid.as_lines(grid.line_profile(picture_rows(spark, a)))).collect()
    assert [(r.detected, r.lo_end, r.hi_start) for r in got] == [(False, 100, 100)] * 2
    assert {r.row_fallback for r in grid.panels(grid.detect_axes(grid.as_lines(grid.line_profile(picture_rows(spark, a))))).collect()} == {True}


def test_gutter_border_and_panels(spark):
    a = np.full((120, 160, 3), 255, np.uint8)
    a[4:55, 6:76], a[4:55, 84:154], a[63:116, 6:76], a[63:116, 84:154] = 50, 100, 150, 200
    axes = grid.detect_axes(grid.as_lines(grid.line_profile(picture_rows(spark, a))))
    got = {r.axis: (r.lo_end, r.hi_start, r.content_start, r.content_end, r.detected) for r in axes.collect()}
    assert got == {0: (55, 63, 4, 116, True), 1: (76, 84, 6, 154, True)}
    boxes = [(r.panel_no, r.left, r.upper, r.right, r.lower) for r in grid.panels(axes).orderBy("panel_no").collect()]
    assert boxes == [(1, 6, 4, 76, 55), (2, 84, 4, 154, 55), (3, 6, 63, 76, 116), (4, 84, 63, 154, 116)]


def test_blank_picture_and_ties(spark):
    blank = np.full((60, 60, 3), 255, np.uint8)
    tie = np.zeros((60, 60, 3), np.uint8)
    tie[22:26] = tie[34:38] = 255  # equally far from the middle: the first wins
    got = {(r.image_id, r.axis): r for r in grid.detect_axes(grid.as_lines(grid.line_profile(picture_rows(spark, blank, tie)))).collect()}
    assert (got["0", 0].content_start, got["0", 0].content_end, got["0", 0].detected) == (0, 60, False)
    assert (got["1", 0].lo_end, got["1", 0].hi_start) == (22, 26)


def test_render_has_the_size_and_no_metadata(spark, tmp_path):
    a = np.zeros((40, 60, 3), np.uint8)
    a[..., 0], a[..., 1] = 200, np.arange(60)
    parts = F.array(F.struct(F.lit("p.png").alias("out_path"), *(F.lit(v).alias(c) for c, v in (("x", 10), ("y", 5), ("w", 20), ("h", 25), ("tw", 108), ("th", 135)))))
    made = grid.render(picture_rows(spark, a).withColumn("parts", parts))
    done = M.write_files(made, f"file://{tmp_path}").collect()
    assert [(r.out_path, r.error) for r in done] == [("p.png", None)]
    back = M.pictures(spark, str(tmp_path)).first()
    assert (back.height, back.width) == (135, 108)
    assert abs(np.frombuffer(back.rgb, np.uint8).reshape(135, 108, 3)[..., 0].mean() - 200) < 1
    scanned = M.scan(spark, str(tmp_path))
    assert [r.findings for r in reports.audit(scanned.select("path", "rel_path", "content")).collect()] == [[]]
    assert M.unsupported(spark, str(tmp_path)).count() == 0


def test_writer_refuses_escapes(spark, tmp_path):
    rows = spark.createDataFrame([("../x", bytearray(b"1")), ("ok/y", bytearray(b"22"))], "out_path string, content binary")
    got = {r.out_path: (r.written, r.error) for r in M.write_files(rows, f"file://{tmp_path}").collect()}
    assert got["ok/y"] == (2, None) and got["../x"][0] == 0 and "escapes" in got["../x"][1]


def test_resize_keeps_constants_and_shrinks_to_size():
    a = np.full((50, 70, 3), 99, np.uint8)
    for w, h in ((20, 10), (140, 200)):
        out = grid.resize(a, w, h)
        assert out.shape == (h, w, 3) and (out == 99).all()


def test_alpha_and_gray_pictures(spark):
    rgba = np.array([[[10, 20, 30, 255], [10, 20, 30, 0]]], np.uint8)  # BGRA
    rows = spark.createDataFrame([("a", 1, 2, 4, bytearray(rgba.tobytes())), ("g", 1, 1, 1, bytearray(b"\x07"))], "origin string, height int, width int, nChannels int, data binary")
    got = {r.path: bytes(r.rgb) for r in M.to_rgb(rows).collect()}
    assert got == {"a": bytes([30, 20, 10, 255, 255, 255]), "g": b"\x07\x07\x07"}


def origin(spark, data, path="/a/x.png"):
    row = reports.audit(spark.createDataFrame([(path, path, bytearray(data))], "path string, rel_path string, content binary")).first()
    return row.verdict, [e.label for e in row.evidence], row.synthid


def test_verdicts(spark):
    assert origin(spark, png(chunk(b"tEXt", b"Software\0made with Sora")))[0] == "ai-declared"
    assert origin(spark, png(chunk(b"tEXt", b"note\0thesoran")))[0] == "ai-declared"  # names match inside words
    assert origin(spark, png(chunk(b"tEXt", b"Workflow\0{}")))[:2] == ("ai-declared", ["Generation record embedded"])
    assert origin(spark, png())[:2] == ("unknown", ["No metadata at all"])
    both = origin(spark, jpeg(seg(0xFE, b"compositeWithTrainedAlgorithmicMedia SynthID")))
    assert both[0] == "ai-declared" and len(both[1]) == 2 and both[2] == "declared"
    assert origin(spark, jpeg(seg(0xE1, EXIF)))[0] == "unknown"  # one camera tag is not three


def test_whole_words(spark):
    from mediasieve.operators.findings import with_findings
    from mediasieve.operators.origin import assess
    from mediasieve.operators.records import walk

    data = [("1", bytearray(png(chunk(b"tEXt", b"n\0thesoran")))), ("2", bytearray(png(chunk(b"tEXt", b"n\0by sora"))))]
    found = with_findings(walk(spark.createDataFrame(data, "path string, content binary"))).withColumn("is_video", F.lit(False))
    assert [r.verdict for r in assess(found, whole_words=True).orderBy("path").collect()] == ["unknown", "ai-declared"]


def test_unreadable_files_are_rows(spark):
    rows = spark.createDataFrame([("a", "a", None), ("b", "b", bytearray(png()))], "path string, rel_path string, content binary")
    assert sorted((r.path, r.error) for r in reports.audit(rows).collect()) == [("a", "unreadable"), ("b", None)]


def test_detected_boxes_need_consent(spark):
    row = spark.range(1).select(video.actionable(F.lit(True)), video.actionable(F.lit(False)), video.actionable(F.lit(False), accept_detected=True)).first()
    assert list(row) == [True, False, True]


def test_suggested_crop_leaves_the_box_out(spark):
    box = F.struct(*(F.lit(v).alias(c) for c, v in zip("xywh", (1600, 900, 200, 100))))
    got = video.suggest_crops(spark.range(1).select(F.col("id").alias("video_id"), F.lit(1920).alias("src_w"), F.lit(1080).alias("src_h"), box.alias("box"))).collect()
    for r in got:
        assert r.w % 2 == r.h % 2 == 0 and (r.x + r.w <= 1600 or r.x >= 1800 or r.y + r.h <= 900 or r.y >= 1000)
    none = F.struct(*(F.lit(v).alias(c) for c, v in zip("xywh", (0, 0, 64, 64))))
    small = video.suggest_crops(spark.range(1).select(F.col("id").alias("video_id"), F.lit(64).alias("src_w"), F.lit(64).alias("src_h"), none.alias("box"))).collect()
    assert {r.w for r in small} == {None} and len(small) == 2


def test_whole_frames_and_pixels_agree(spark):
    pixels = X.frame_pixels(spark, SF)
    pixels = pixels.where(F.col("video_id") == pixels.agg(F.min("video_id")).first()[0])
    whole = pixels.groupBy("video_id", "t").agg(F.array_sort(F.collect_list(F.struct("y", "x", "gray"))).alias("p"))
    rows = [(r.video_id, 96, 128, bytearray(int(p.gray) for p in r.p)) for r in whole.collect()]
    sums = frames.frame_stats(spark.createDataFrame(rows, "video_id long, height int, width int, gray binary"))
    worst = sums.alias("a").join(frames.pixel_stats(pixels).alias("b"), ["video_id", "y", "x"]).agg(F.max(F.abs(F.col("a.std") - F.col("b.std"))), F.count("*")).first()
    assert worst[0] < 1e-6 and worst[1] == 96 * 128


@pytest.fixture(scope="module")
def pan():
    """A smooth picture that moves 4 pixels a frame under a still mark."""
    rng = np.random.default_rng(1)
    spectrum = np.fft.fft2(rng.normal(size=(96, 256)))
    f = np.hypot(*np.meshgrid(np.fft.fftfreq(256), np.fft.fftfreq(96)))
    world = np.real(np.fft.ifft2(spectrum * np.exp(-((f / 0.08) ** 2))))
    world = 40 + 170 * (world - world.min()) / np.ptp(world)
    clean = [np.roll(world, -4 * t, axis=1)[:, :128] for t in range(16)]
    marked = [c.copy() for c in clean]
    for m in marked:
        m[70:82, 90:104] = 250
    return clean, marked


def test_hidden_content_comes_from_other_frames(spark, pan):
    clean, marked = pan
    rows = [(1, t, 96, 128, bytearray(m.astype(np.uint8).tobytes())) for t, m in enumerate(marked)]
    clip = spark.createDataFrame(rows, "video_id long, t int, height int, width int, gray binary")
    box = spark.createDataFrame([(1, 90, 70, 14, 12)], "video_id long, x int, y int, w int, h int")
    found = frames.match_frames(clip, box, chunk=6)
    got = {r.t: r for r in found.collect()}
    assert len(got) == 16
    errors = []
    for t, r in got.items():
        if r.matched and 0 < t + 4 < 16:
            patch = np.frombuffer(r.patch, np.uint8).reshape(12, 14)
            errors.append(np.abs(patch - clean[t][70:82, 90:104]).mean())
            assert abs(abs(r.dx) - 4 * abs(r.source - t)) < 1
    assert errors and np.median(errors) < 4
    summary = frames.recovery(found).first()
    assert summary.frames == 16 and summary.recovered >= 10


def test_scalar_quality_bands(spark):
    got = [spark.range(1).select(frames.quality_band(F.lit(x))).first()[0] for x in (5.9, 6.0, 14.9, 15.0)]
    assert got == ["clean", "soft", "soft", "too busy"]


def test_videos_are_audited_with_their_probe_texts(spark):
    """Tags are findings and searched for names; a WebM file is a video whatever its bytes; sizes come from the stream."""
    media = spark.createDataFrame(
        [("a", "x/a.webm", bytearray(b"\x1aE\xdf\xa3")), ("b", "b.mp4", bytearray(b"\0\0\0\x10ftypisom\0\0\0\0")), ("c", "c.webm", bytearray(b"")), ("d", "noext", bytearray(b"\0\0\0\x10ftypisom\0\0\0\0"))],
        "path string, rel_path string, content binary",
    )
    stream = '{"codec_type":"video","width":1024,"height":1024,"tags":{"handler_name":"v","Encoder":"Midjourney"}}'
    texts = spark.createDataFrame([("a", '{"format":{"tags":{"title":"t","major_brand":"x"}},"streams":[' + stream + "]}"), ("a", None), ("b", "no json")], "path string, t string")
    got = {r.path: r for r in reports.audit(media, texts.select("path", M.probe(F.col("t")).alias("probe"))).collect()}
    assert [(f.kind, f.label, f.detail) for f in got["a"].findings] == [("tag", "container tag title", "t"), ("tag", "stream 0 tag Encoder", "Midjourney")]
    assert (got["a"].verdict, got["a"].width, got["a"].is_video, got["a"].rel_path) == ("ai-declared", 1024, True, "x/a.webm")
    assert [e.label for e in got["a"].evidence] == ["Generator named in metadata", "Size typical of a generator"]
    assert all(got[k].is_video and got[k].verdict == "unknown" and got[k].evidence == [] for k in "bcd")
    assert len({reports.audit(media).where(F.col("path") == "c").first().synthid_note, "x"}) == 2


def test_the_clean_report_flags_declared_watermarks(spark):
    media = spark.createDataFrame([("a", bytearray(jpeg(seg(0xFE, b"SynthID here")))), ("b", bytearray(jpeg()))], "path string, content binary")
    assert {r.path: r.declares_watermark for r in clean.verify(media).collect()} == {"a": True, "b": False}
    assert clean.clean(media, with_bytes=False).where("cleaned IS NOT NULL").count() == 0


def test_written_files_replace_each_other_whole(spark, tmp_path):
    files = spark.createDataFrame([("d/x.png", bytearray(b"a" * 9)), ("d/x.png", bytearray(b"b" * 9)), ("../y", bytearray(b"c"))], "out_path string, content binary")
    got = M.write_files(files, "file://" + str(tmp_path)).collect()
    assert sorted(r.written for r in got) == [0, 9, 9]
    assert [p.name for p in (tmp_path / "d").iterdir()] == ["x.png"] and (tmp_path / "d/x.png").read_bytes() in (b"a" * 9, b"b" * 9)


def audited_names(spark, names, **how):
    from mediasieve.operators import findings, origin
    from mediasieve.operators.records import walk

    media = X.media(spark, SF)
    found = findings.with_findings(walk(media)).withColumn("is_video", F.col("container") == "iso")
    return {r.path: [tuple(e) for e in r.evidence] for r in origin.assess(found, names, **how).collect()}


def test_many_names_are_found_as_few_are(spark):
    from mediasieve.functions.dictionaries import GENERATOR_NAMES

    some = (*GENERATOR_NAMES[:30], "the", "er a", "(x", "é")
    noise = tuple(f"no such name {k}" for k in range(20_000))
    for how in ({}, {"whole_words": True}):
        few = audited_names(spark, some, **how)
        assert audited_names(spark, (*some, *noise), **how) == few
        assert any("Generator named in metadata" in e[1] for es in few.values() for e in es)


def test_long_inflated_texts_are_whole(spark):
    import zlib

    from mediasieve.functions import containers
    from mediasieve.operators.records import describe

    body = b"Comment\0\0" + zlib.compress(b"word " * 10_000_000 + b"made with ComfyUI")
    media = spark.createDataFrame([("a.png", "a.png", bytearray(png(chunk(b"zTXt", body))))], "path string, rel_path string, content binary")
    row = reports.audit(media).select("verdict", F.length(F.element_at("text_kv", F.lit("Comment"))).alias("n")).first()
    assert (row.verdict, row.n) == ("ai-declared", 50_000_017)
    bomb = png(chunk(b"zTXt", b"k\0\0" + zlib.compress(bytes(containers.MAX_TEXT + 1))), chunk(b"tEXt", b"a\0b"))
    got = describe("p", bomb)
    assert "after inflation" in got["error"] and dict(got["text_kv"]) == {"a": "b"} and got["width"] == 40
