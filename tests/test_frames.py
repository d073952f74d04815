"""Frame analytics from whole frames against the tabular forms and plain numpy."""

import hashlib
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediasieve.jobs.queries import QUERIES
from mediasieve.operators import frames
from mediasieve.sources import fixtures as X

SF = "/root/testdata/sf0.001"


def clip_rows(spark, clips):
    rows = [(v, t, a.shape[1], a.shape[2], bytearray(f.tobytes())) for v, a in clips.items() for t, f in enumerate(a)]
    return spark.createDataFrame(rows, "video_id long, t int, height int, width int, gray binary").repartition(5)


def make_clips():
    rnd = np.random.default_rng(3)
    clips = {}
    for v, (h, w, n) in enumerate([(96, 128, 16), (100, 140, 14), (64, 64, 4), (40, 300, 3), (97, 129, 14), (70, 71, 2)], 1):
        a = rnd.integers(0, 150, (n, h, w), dtype=np.uint8)
        if v != 3:
            a[:, 2:10, 3:11] = 220  # still, bright, in a corner
        if v == 2:
            a[:, h - 11 : h - 3, w - 12 : w - 4] = 240
        clips[v] = a
    clips[9] = np.full((3, 80, 80), 128, np.uint8)  # nothing moves
    return clips


@pytest.fixture(scope="module")
def clips():
    return make_clips()


def as_pixels(spark, clips):
    rows = [(v, t, y, x, float(a[t, y, x])) for v, a in clips.items() for t in range(a.shape[0]) for y in range(a.shape[1]) for x in range(a.shape[2])]
    return spark.createDataFrame(rows, "video_id long, t int, y int, x int, gray double")


def test_sums_by_tile_are_exact_whatever_a_task_holds(spark, clips, monkeypatch):
    want = {(v, ty, tx): (len(a), a[:, ty : ty + 64, tx : tx + 64].astype(int).sum(axis=0), (a[:, ty : ty + 64, tx : tx + 64].astype(int) ** 2).sum(axis=0)) for v, a in clips.items() for ty in range(0, a.shape[1], 64) for tx in range(0, a.shape[2], 64)}
    for held in (1, 300_000, 64 << 20):
        monkeypatch.setattr(frames, "_HELD", held)
        got = frames.tile_moments(clip_rows(spark, clips)).collect()
        assert len(got) == len(want)
        for r in got:
            n, s, q = want[r.video_id, r.ty, r.tx]
            assert r.n == n and np.array_equal(np.frombuffer(r.s, "<i8"), s.ravel()) and np.array_equal(np.frombuffer(r.q, "<i8"), q.ravel())
    assert frames.tile_moments(clip_rows(spark, clips).limit(0)).count() == 0


def test_marks_and_detail_equal_the_tabular_forms(spark, clips):
    whole = clip_rows(spark, clips).cache()
    pixels = as_pixels(spark, {v: a for v, a in clips.items() if v != 4}).cache()
    key = lambda df: sorted(tuple(r[c] for c in ("video_id", "corner", "x", "y", "w", "h", "mass", "rank")) for r in df.collect())
    found = frames.overlay_marks(whole.where("video_id <> 4"))
    assert key(found) == key(frames.overlay_candidates(frames.pixel_stats(pixels))) and found.count() >= 3
    boxes = found.where("rank = 1").select("video_id", "x", "y", "w", "h").unionByName(spark.createDataFrame([(3, 0, 0, 1, 1), (9, 79, 79, 1, 1)], "video_id long, x int, y int, w int, h int"))
    detail = lambda df: {r.video_id: round(r.detail, 9) for r in df.collect()}
    assert detail(frames.box_detail(whole, boxes)) == detail(frames.border_detail(pixels, boxes))
    assert frames.overlay_marks(whole.limit(0)).count() == 0


def test_selected_order_statistics_equal_numpy(spark, clips):
    tiles = frames.tile_moments(clip_rows(spark, clips))
    for r in frames.tile_quantiles(tiles).collect():
        a = clips[r.video_id].astype(int)
        n, h, w = a.shape
        if r.what == -1:
            values, q = (n * (a * a).sum(axis=0) - a.sum(axis=0) ** 2).ravel(), 0.5
        else:
            corner = frames._corner_numbers(h, w, 0, 0, (h, w))
            values, q = a.sum(axis=0)[corner == r.what], 0.9
        ordered, place = np.sort(values), q * (len(values) - 1)
        assert (r.low, r.high) == (ordered[int(np.floor(place))], ordered[int(np.ceil(place))])
        assert abs(r.part - (place - np.floor(place))) < 1e-9


def test_no_row_a_pixel_in_the_plan(spark, clips):
    plan = frames.overlay_marks(clip_rows(spark, clips))._jdf.queryExecution().toString()
    assert "percentile" not in plan and "gray" not in plan.split("== Physical Plan ==")[-1]


def test_large_frames_take_little_memory():
    """Sums of a 4K clip as a task makes them: two integers a pixel, and one frame."""
    rnd = np.random.default_rng(0)
    frame = rnd.integers(0, 255, (2160, 3840), dtype=np.uint8)
    tracemalloc.start()
    s, q = np.zeros(frame.shape, np.uint32), np.zeros(frame.shape, np.uint32)
    for _ in range(2):
        a = frame.astype(np.uint32)
        s += a
        q += a * a
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_spectra_are_kept_up_to_a_bound():
    made = []

    def band(t):
        made.append(t)
        return np.random.default_rng(t).normal(size=(32, 64))

    spectra = frames._Spectra(band, held=4 * 32 * 33 * 8)
    first = spectra[0]
    assert spectra[0] is first and made == [0]
    for t in range(1, 6):
        spectra[t]
    assert len(spectra._known) == 4 and np.allclose(spectra[0], first) and made == [0, 1, 2, 3, 4, 5, 0]


def test_rebuilt_frames_equal_a_plain_loop(spark):
    clips = X.pan_frames(spark, SF).where("video_id <= 3").cache()
    boxes = clips.select("video_id").distinct().where("video_id <> 3").select("video_id", *(F.lit(v).alias(c) for c, v in zip("xywh", X.MARK)))
    whole = {(r.video_id, r.t): np.frombuffer(r.gray, np.uint8).reshape(96, 128) for r in clips.collect()}
    patches = {(r.video_id, r.t): r.patch for r in frames.match_frames(clips, boxes).collect() if r.matched}
    x, y, w, h = X.MARK
    made = frames.rebuilt_frames(clips, boxes, chunk=5).collect()
    assert len(made) == len(whole)
    for r in made:
        want = whole[r.video_id, r.t].copy()
        if (r.video_id, r.t) in patches:
            want[y : y + h, x : x + w] = np.frombuffer(patches[r.video_id, r.t], np.uint8).reshape(h, w)
        assert r.matched == ((r.video_id, r.t) in patches) and np.array_equal(np.frombuffer(r.gray, np.uint8).reshape(96, 128), want)
    assert {r.matched for r in made if r.video_id == 3} == {False}


def moved_columns(df, *kinds):
    """Names of the columns that exchanges of a plan carry; kinds as plans name them."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    found = re.findall(r"\(\d+\) (\w+)\nInput \[\d+\]: \[(.*?)\]\n", plan)
    assert any(kind == "Exchange" for kind, _ in found)
    return {c.split("#")[0] for kind, columns in found if kind in kinds for c in columns.split(", ")}


def test_recovery_moves_no_frame(spark):
    """Frames are made where their video lies and stay there; a picture is drawn once for all frames that show it."""
    assert not {"gray", "patch"} & moved_columns(QUERIES["frame_recovery"](spark, SF), "Exchange")
    drawn = X.pan_frames(spark, SF).select("video_id", "t", F.sha2("gray", 256).alias("h")).collect()
    y, x = np.mgrid[0:96, 0:128]
    x0, y0, w, h = X.MARK
    for v, t, digest in drawn:
        at = x + t * (3 + v % 3)
        a = (128 + 50 * np.sin(at * 0.13 + y * 0.21) + 40 * np.sin(at * 0.071 - y * 0.11) + 25 * np.cos(at * 0.31 + y * 0.017 * at * 0.05)).astype(int)
        a[y0 : y0 + h, x0 : x0 + w] = 250
        assert hashlib.sha256(a.astype(np.uint8).tobytes()).hexdigest() == digest


def test_neighbours_stay_within_a_videos_chunks(spark):
    frame = lambda v, t: (v, t, 1, 1, bytearray(b"x"))
    known = {1: range(12), 2: range(-7, 31), 3: (0, 40), 4: (5,)}
    rows = spark.createDataFrame([frame(v, t) for v, ts in known.items() for t in ts] + [frame(4, None)], "video_id long, t int, height int, width int, gray binary")
    boxes = spark.createDataFrame([(v, 0, 0, 1, 1) for v in known], "video_id long, x int, y int, w int, h int")
    got = sorted((r.video_id, r.t, r.part) for r in frames.with_neighbours(rows, boxes, 5, 10).collect())
    want = sorted((v, t, p) for v, ts in known.items() for t in ts for p in range(min(ts) // 10, max(ts) // 10 + 1) if (t - 5) // 10 <= p <= (t + 5) // 10)
    assert got == want


def test_columns_that_nothing_asks_for_do_not_change_what_is_moved():
    frame = np.random.default_rng(5).integers(0, 255, (40, 90), dtype=np.uint8)
    for dx, dy in ((0.0, 0.0), (3.25, -1.5), (-60.5, 30.1), (75.0, -39.9)):
        whole = frames._moved(frame, dx, dy, (0, 0, 90, 40))
        assert np.array_equal(frames._moved(frame, dx, dy, (30, 7, 51, 33)), whole[7:33, 30:51])


def test_rebuilding_moves_no_frame(spark):
    assert "gray" not in moved_columns(QUERIES["rebuilt_frames"](spark, SF), "Exchange")


def test_clips_are_those_of_the_pixels(spark):
    whole = {(r.video_id, r.t): np.frombuffer(r.gray, np.uint8) for r in X.frame_clips(spark, SF, 3).collect()}
    pixels = X.frame_pixels(spark, SF, 3).groupBy("video_id", "t").agg(F.array_sort(F.collect_list(F.struct("y", "x", "gray"))).alias("p")).select("video_id", "t", "p.gray").collect()
    assert len(pixels) == len(whole) and all(np.array_equal(np.array(r.gray), whole[r.video_id, r.t]) for r in pixels)


def test_tiles_are_small_and_stay_where_they_are(spark, clips):
    """Sums take as many bytes as they need, and limits go to the tiles, not tiles to the limits."""
    for r in frames.packed_moments(clip_rows(spark, clips)).collect():
        pixels = min(64, r.height - r.ty) * min(64, r.width - r.tx)
        assert len(r.s) == 2 * pixels and len(r.q) in (2 * pixels, 4 * pixels)
    assert frames._packed(np.array([1 << 40, 3])) == np.array([1 << 40, 3], "<i8").tobytes()
    assert not {"s", "q"} & moved_columns(QUERIES["overlay_candidates"](spark, SF), "Exchange", "BroadcastExchange")


def test_bands_are_measured_where_frames_are(spark):
    assert "gray" not in moved_columns(QUERIES["repair_bands"](spark, SF), "Exchange", "BroadcastExchange")
