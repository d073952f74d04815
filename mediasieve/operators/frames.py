"""Frame analytics: still marks in corners, border detail, and repair from neighbouring frames."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediasieve.sources.shared import checkpointed

#: (order, name) of corners.
CORNERS = ((0, "top-left"), (1, "top-right"), (2, "bottom-left"), (3, "bottom-right"))


def sample_frames(frames: DataFrame, count: int = 24) -> DataFrame:
    """The first frame of each sampling step of ``frames(video_id, ts, duration, ..)``, ``count`` at most; videos with one frame go.

    The rate is max(0.5, count / duration) a second, or 2 without a duration.
    """
    rate = F.when(F.col("duration") > 0, F.greatest(F.lit(0.5), F.lit(float(count)) / F.col("duration"))).otherwise(F.lit(2.0))
    step = frames.withColumn("_step", F.floor(F.col("ts") * rate))
    first = step.withColumn("_n", F.row_number().over(W.partitionBy("video_id", "_step").orderBy("ts"))).where("_n = 1").drop("_n")
    ranked = first.withColumn("sample_no", F.row_number().over(W.partitionBy("video_id").orderBy("_step")))
    kept = ranked.where(F.col("sample_no") <= count)
    return kept.withColumn("_all", F.count("*").over(W.partitionBy("video_id"))).where("_all >= 2").drop("_step", "_all")


def pixel_stats(pixels: DataFrame) -> DataFrame:
    """(video_id, y, x, mean, std) over time of ``pixels(video_id, t, y, x, gray)``; std is of the population."""
    return pixels.groupBy("video_id", "y", "x").agg(F.avg("gray").alias("mean"), F.stddev_pop("gray").alias("std"))


def frame_stats(frames: DataFrame) -> DataFrame:
    """``pixel_stats`` from whole frames ``frames(video_id, height, width, gray)``, gray as bytes.

    Each task sums its frames' values and squares for each video first, so one
    row a task and video is shuffled, not frames.
    """

    def partial(batches):
        sums: dict[tuple, list] = {}
        for pdf in batches:
            for v, h, w, data in zip(pdf["video_id"], pdf["height"], pdf["width"], pdf["gray"]):
                a = np.frombuffer(data, np.uint8).astype(np.float64)
                s = sums.setdefault((v, h, w), [0, np.zeros(h * w), np.zeros(h * w)])
                s[0] += 1
                s[1] += a
                s[2] += a * a
        rows = [(v, h, w, n, s.tobytes(), q.tobytes()) for (v, h, w), (n, s, q) in sums.items()]
        yield pd.DataFrame(rows, columns=["video_id", "height", "width", "n", "s", "q"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].sum()
        s, q = (sum(np.frombuffer(b) for b in pdf[c]) for c in ("s", "q"))
        mean = s / n
        at = np.arange(len(mean))
        w = int(pdf["width"].iloc[0])
        return pd.DataFrame({"video_id": pdf["video_id"].iloc[0], "y": (at // w).astype("int32"), "x": (at % w).astype("int32"), "mean": mean, "std": np.sqrt(np.maximum(q / n - mean * mean, 0))})

    sums = frames.select("video_id", "height", "width", "gray").mapInPandas(partial, "video_id long, height int, width int, n long, s binary, q binary")
    return sums.groupBy("video_id", "height", "width").applyInPandas(merge, "video_id long, y int, x int, mean double, std double")


def overlay_candidates(stats: DataFrame) -> DataFrame:
    """(video_id, corner, x, y, w, h, mass, rank): still, bright, compact marks in the corners, largest first.

    ``stats`` as ``pixel_stats`` gives them. A candidate is a guess: captions
    and lamps look the same, so nothing may act on it without consent.
    """
    size = stats.groupBy("video_id").agg(F.max("y").alias("_y"), F.max("x").alias("_x"), F.percentile("std", F.lit(0.5)).alias("moving"))
    size = size.select("video_id", (F.col("_y") + 1).alias("H"), (F.col("_x") + 1).alias("W"), "moving").where("moving >= 1.5")
    size = size.withColumn("qh", F.floor(F.col("H") * 0.22).cast("int")).withColumn("qw", F.floor(F.col("W") * 0.30).cast("int"))
    top, left = F.col("y") < F.col("qh"), F.col("x") < F.col("qw")
    bottom, right = F.col("y") >= F.col("H") - F.col("qh"), F.col("x") >= F.col("W") - F.col("qw")
    corner = F.when(top & left, 0).when(top & right, 1).when(bottom & left, 2).when(bottom & right, 3)
    inside = stats.join(size, "video_id").withColumn("corner_no", corner).where("corner_no IS NOT NULL")
    cut = inside.groupBy("video_id", "corner_no").agg(F.greatest(F.lit(90.0), F.percentile("mean", F.lit(0.9))).alias("cut"))
    hits = inside.join(cut, ["video_id", "corner_no"]).where((F.col("std") < F.greatest(F.lit(1.0), F.col("moving") * 0.6)) & (F.col("mean") > F.col("cut")))
    blobs = hits.groupBy("video_id", "corner_no", "H", "W").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x") + 1).alias("bw"), (F.max("y") - F.min("y") + 1).alias("bh"), F.count("*").alias("mass"))
    return _compact_marks(blobs)


def _compact_marks(blobs: DataFrame) -> DataFrame:
    """Candidates from the hits' box and number in each corner: (video_id, corner_no, H, W, x0, y0, bw, bh, mass)."""
    bw, bh = F.col("bw"), F.col("bh")
    good = blobs.where((F.col("mass") >= 40) & (bw >= 8) & (bh >= 8) & (bw <= F.col("W") * 0.22) & (bh <= F.col("H") * 0.14) & (F.greatest(bw, bh) / F.least(bw, bh) <= 2.5) & (F.col("mass") / (bw * bh) >= 0.10))
    pw, ph = F.greatest(F.lit(6), F.floor(bw * 0.25)).cast("int"), F.greatest(F.lit(6), F.floor(bh * 0.25)).cast("int")
    x, y = F.greatest(F.lit(0), F.col("x0") - pw), F.greatest(F.lit(0), F.col("y0") - ph)
    names = F.create_map(*(F.lit(v) for c in CORNERS for v in c))
    padded = good.select(
        "video_id", "corner_no", F.element_at(names, F.col("corner_no")).alias("corner"), x.alias("x"), y.alias("y"),
        (F.least(F.col("W"), F.col("x0") + bw + pw) - x).alias("w"), (F.least(F.col("H"), F.col("y0") + bh + ph) - y).alias("h"), "mass",
    )
    return padded.withColumn("rank", F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("mass"), "corner_no"))).drop("corner_no")


#: Pixels of a tile's side, and bytes of sums that a task holds before it hands them on.
TILE, _HELD = 64, 64 << 20
_ALL = -1  # the whole frame, beside the corners' numbers
_TILES = "video_id long, height int, width int, ty int, tx int, n long, s binary, q binary"


def _packed(values: np.ndarray) -> bytes:
    """Non-negative integers in 2, 4 or 8 bytes each, as the largest needs."""
    most = int(values.max(initial=0))
    return values.astype("<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<i8").tobytes()


def _unpacked(data: bytes | pa.Buffer, height: int, width: int, ty: int, tx: int) -> np.ndarray:
    """A tile's integers, whatever their width."""
    shape = min(TILE, height - ty), min(TILE, width - tx)
    kind = {2: "<u2", 4: "<u4", 8: "<i8"}[len(data) // (shape[0] * shape[1])]
    return np.frombuffer(data, kind).astype(np.int64, copy=False).reshape(shape)


def tile_moments(frames: DataFrame) -> DataFrame:
    """(video_id, height, width, ty, tx, n, s, q): for each tile of a video how many frames it has, and each pixel's sum and sum of squares, in 64 bits each."""

    def widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                row = one.to_pylist()[0]
                s, q = (pa.array([_unpacked(row[c], *(row[x] for x in ("height", "width", "ty", "tx"))).tobytes()]) for c in "sq")
                yield pa.RecordBatch.from_arrays([*one.columns[:-2], s, q], names=one.schema.names)

    return packed_moments(frames).mapInArrow(widened, _TILES)


def packed_moments(frames: DataFrame) -> DataFrame:
    """``tile_moments`` with each tile's sums in no more bytes than its largest needs.

    ``frames(video_id, height, width, gray)`` with gray as bytes. Sums are exact
    integers, merged in two steps, so a video that most tasks have frames of is
    no single task's work. Tasks hand on what they hold when it passes a bound.
    """
    schema = pa.schema([("part", pa.int32()), ("video_id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("ty", pa.int32()), ("tx", pa.int32()), ("n", pa.int64()), ("s", pa.binary()), ("q", pa.binary())])

    def flush(sums: dict, part: int) -> Iterator[pa.RecordBatch]:
        for (v, h, w), (n, s, q) in sums.items():
            tiles = [(part, v, h, w, y, x, n, _packed(s[y : y + TILE, x : x + TILE]), _packed(q[y : y + TILE, x : x + TILE])) for y in range(0, h, TILE) for x in range(0, w, TILE)]
            for k in range(0, len(tiles), 64):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*tiles[k : k + 64]), schema)], schema=schema)
        sums.clear()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        held, part = 0, TaskContext.get().partitionId() % 32
        for batch in batches:
            for v, h, w, data in zip(*(batch.column(k) for k in range(4))):
                key = v.as_py(), h.as_py(), w.as_py()
                if key not in sums:
                    if held + 8 * key[1] * key[2] > _HELD:
                        yield from flush(sums, part)
                        held = 0
                    sums[key] = [0, np.zeros(key[1:], np.uint32), np.zeros(key[1:], np.uint32)]
                    held += 8 * key[1] * key[2]
                one = sums[key]
                a = np.frombuffer(data.as_buffer(), np.uint8).reshape(key[1:]).astype(np.uint32)
                one[0] += 1
                one[1] += a
                one[2] += a * a
                if one[0] == 60_000:  # squares of more could pass 32 bits
                    yield from flush(sums, part)
                    held = 0
        yield from flush(sums, part)

    def merge(table: pa.Table) -> pa.Table:
        if table.num_rows == 1:
            return table
        first = table.slice(0, 1)
        place = [first.column(c)[0].as_py() for c in ("height", "width", "ty", "tx")]
        total = lambda c: sum(_unpacked(v.as_buffer(), *place) for v in table.column(c))
        for name, value in (("n", pa.array([sum(table.column("n").to_pylist())])), ("s", pa.array([_packed(total("s"))])), ("q", pa.array([_packed(total("q"))]))):
            first = first.set_column(first.schema.get_field_index(name), name, value)
        return first

    key = ("video_id", "height", "width", "ty", "tx")
    sums = frames.select(F.col("video_id").cast("long"), "height", "width", "gray").mapInArrow(partial, "part int, " + _TILES)
    some = sums.groupBy(*key, "part").applyInArrow(merge, "part int, " + _TILES).drop("part")
    return some.groupBy(*key).applyInArrow(merge, _TILES)


def _corner_numbers(h: int, w: int, ty: int, tx: int, shape: tuple[int, int]) -> np.ndarray:
    """The number of the corner that each pixel of a tile is in, -1 for none."""
    qh, qw = int(h * 0.22), int(w * 0.30)
    y, x = ty + np.arange(shape[0])[:, None], tx + np.arange(shape[1])[None, :]
    row = np.where(y < qh, 0, np.where(y >= h - qh, 2, -9))
    col = np.where(x < qw, 0, np.where(x >= w - qw, 1, -9))
    return np.maximum(row + col, -1)


def _tile(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(corner numbers, sums, n^2 times the variance) of a tile, as integers."""
    place = [row[c] for c in ("height", "width", "ty", "tx")]
    s, q = (_unpacked(row[c], *place) for c in "sq")
    return _corner_numbers(*place, s.shape), s, row["n"] * q - s * s


def _bin(values: np.ndarray) -> np.ndarray:
    """Bins of non-negative integers in their order: by the number of bits and the seven leading ones."""
    bits = np.frexp(values.astype(np.float64))[1].astype(np.int64)
    shift = np.maximum(bits - 8, 0)
    return bits << 8 | values >> shift


def _by_tile(tiles: DataFrame, work: Callable[[dict], list[tuple]], schema: str, names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [{"long": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in schema.split(", ")]
        for batch in batches:
            for k in range(batch.num_rows):
                rows = work(batch.slice(k, 1).to_pylist()[0])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)

    return tiles.mapInArrow(run, schema)


def _distinct(video: int, what: int, values: np.ndarray) -> list[tuple]:
    found, counts = np.unique(values, return_counts=True)
    return [(video, what, v, n) for v, n in zip(found.tolist(), counts.tolist())]


def tile_quantiles(tiles: DataFrame, share_all: float = 0.5, share_corner: float = 0.9) -> DataFrame:
    """(video_id, what, low, high, part): exact order statistics beside a quantile's place, and its place between them.

    ``what`` is -1 for n^2 times the variance over the whole frame, or a
    corner's number for sums in it. Histograms of each tile are added up for
    each video; the tiles then hand out the values of the one or two bins that
    hold the wanted places, and no others.
    """
    names = ["video_id", "what", "value", "n"]
    schema = "video_id long, what int, value long, n long"

    def each(row: dict) -> list[tuple[int, np.ndarray]]:
        corner, s, v = _tile(row)
        return [(_ALL, v.ravel()), *((k, s[corner == k]) for k in range(4) if (corner == k).any())]

    def histogram(row: dict) -> list[tuple]:
        counts = [(what, np.bincount(_bin(values))) for what, values in each(row)]
        return [(row["video_id"], what, int(b), int(n[b])) for what, n in counts for b in np.flatnonzero(n)]

    def chosen(row: dict) -> list[tuple]:
        bins = {(b["what"], b["value"]) for b in row["bins"]}
        out = []
        for what, values in each(row):
            wanted = [v for w, v in bins if w == what]
            out += _distinct(row["video_id"], what, values[np.isin(_bin(values), wanted)])
        return out

    key = ["video_id", "what"]
    by = W.partitionBy(*key)
    counted = lambda df: df.groupBy(*key, "value").agg(F.sum("n").alias("n")).withColumn("end", F.sum("n").over(by.orderBy("value")))
    share = F.when(F.col("what") == _ALL, share_all).otherwise(share_corner)
    bins = counted(_by_tile(tiles, histogram, schema, names)).withColumn("all", F.sum("n").over(by)).withColumn("place", share * (F.col("all") - 1))
    low, high = F.floor("place"), F.ceil("place")
    holds = lambda place: (F.col("end") - F.col("n") <= place) & (place < F.col("end"))
    held = checkpointed(bins.where(holds(low) | holds(high)).select(*key, "value", (F.col("end") - F.col("n")).alias("before"), "place"))
    wanted = held.groupBy("video_id").agg(F.collect_list(F.struct("what", "value")).alias("bins"))
    values = counted(_by_tile(tiles.join(F.broadcast(wanted), "video_id"), chosen, schema, names))
    # Values of neighbouring bins follow one another, so places go on from the first bin's.
    first = held.groupBy(*key).agg(F.min("before").alias("before"), F.first("place").alias("place"), F.count("*").alias("n_bins"), F.max("before").alias("later"))
    at = values.join(first, key).withColumn("end", F.col("end") + F.col("before"))
    return at.groupBy(*key).agg(F.min(F.when(F.col("end") > low, F.col("value"))).alias("low"), F.min(F.when(F.col("end") > high, F.col("value"))).alias("high"), F.first(F.col("place") - low).alias("part"))


def overlay_marks(frames: DataFrame) -> DataFrame:
    """``overlay_candidates`` from whole frames ``frames(video_id, height, width, gray)``: no row a pixel is made anywhere.

    Integer sums by tile, quantiles by histogram selection, and a box and a
    count of hits by tile and corner are all that leaves the tasks. A task holds
    the sums of the frames that it reads, up to a bound, or one tile. A video's
    limits, one row, are sent to its tiles: Spark takes tiles for smaller than
    they are, and would send those.
    """
    tiles = checkpointed(packed_moments(frames))
    found = tile_quantiles(tiles)
    sizes = tiles.groupBy("video_id").agg(F.first("n").alias("frames"))
    part = F.col("part")
    mid = found.where(f"what = {_ALL}").join(sizes, "video_id")
    moving = mid.select("video_id", ((F.sqrt("low") * (1 - part) + F.sqrt("high") * part) / F.col("frames")).alias("moving")).where("moving >= 1.5")
    cut = found.where(f"what <> {_ALL}").join(sizes, "video_id").select("video_id", F.struct("what", F.greatest(F.lit(90.0), (F.col("low") * (1 - part) + F.col("high") * part) / F.col("frames")).alias("cut")).alias("cut"))
    limits = cut.groupBy("video_id").agg(F.collect_list("cut").alias("cuts")).join(moving, "video_id")

    def hits(row: dict) -> list[tuple]:
        corner, s, v = _tile(row)
        mean, std = s / row["n"], np.sqrt(v) / row["n"]
        quiet = std < max(1.0, 0.6 * row["moving"])
        out = []
        for c in row["cuts"]:
            y, x = np.nonzero((corner == c["what"]) & quiet & (mean > c["cut"]))
            if len(y):
                out.append((row["video_id"], c["what"], row["height"], row["width"], int(x.min()) + row["tx"], int(x.max()) + row["tx"], int(y.min()) + row["ty"], int(y.max()) + row["ty"], len(y)))
        return out

    names = ["video_id", "corner_no", "H", "W", "x_min", "x_max", "y_min", "y_max", "n"]
    boxes = _by_tile(tiles.join(F.broadcast(limits), "video_id"), hits, "video_id long, corner_no int, H int, W int, x_min int, x_max int, y_min int, y_max int, n long", names)
    blobs = boxes.groupBy("video_id", "corner_no", "H", "W").agg(
        F.min("x_min").alias("x0"), F.min("y_min").alias("y0"), (F.max("x_max") - F.min("x_min") + 1).alias("bw"), (F.max("y_max") - F.min("y_min") + 1).alias("bh"), F.sum("n").alias("mass")
    )
    return _compact_marks(blobs)


def box_detail(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """``border_detail`` from whole frames ``frames(video_id, height, width, gray)``: each frame's gradients are summed where it is, one row a frame is added up. Boxes, one row a video, are sent to the frames."""
    schema = "video_id long, gx long, nx long, gy long, ny long, w int, h int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for v, h, w, data, x, y, bw, bh in zip(*(batch.column(k) for k in range(8))):
                h, w, x, y = (e.as_py() for e in (h, w, x, y))
                a = np.frombuffer(data.as_buffer(), np.uint8).reshape(h, w)
                a = a[max(0, y - 10) : y + bh.as_py() + 10, max(0, x - 10) : x + bw.as_py() + 10].astype(np.int16)
                gx, gy = np.abs(np.diff(a, axis=1)), np.abs(np.diff(a, axis=0))
                rows.append((v.as_py(), int(gx.sum()), gx.size, int(gy.sum()), gy.size, a.shape[1], a.shape[0]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32() if k > 4 else pa.int64()) for k, c in enumerate(zip(*rows))], names=["video_id", "gx", "nx", "gy", "ny", "w", "h"])

    near = frames.join(F.broadcast(boxes.select("video_id", "x", "y", "w", "h")), "video_id").select("video_id", "height", "width", "gray", "x", "y", "w", "h")
    sums = near.mapInArrow(run, schema).groupBy("video_id").agg(*(F.sum(c).alias(c) for c in ("gx", "nx", "gy", "ny")), F.max("w").alias("w"), F.max("h").alias("h"))
    mean = lambda a, b: F.col(a) / F.col(b)
    return sums.select("video_id", F.when((F.col("w") < 4) | (F.col("h") < 4), 99.0).otherwise((mean("gx", "nx") + mean("gy", "ny")) / 2).alias("detail"))


def border_detail(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """(video_id, detail): mean absolute gradient in each box of ``boxes(video_id, x, y, w, h)`` grown by 10 pixels, the box included; 99 for strips below 4."""
    grown = boxes.select("video_id", F.greatest(F.lit(0), F.col("x") - 10).alias("bx0"), F.greatest(F.lit(0), F.col("y") - 10).alias("by0"), (F.col("x") + F.col("w") + 10).alias("bx1"), (F.col("y") + F.col("h") + 10).alias("by1"))
    near = pixels.join(grown, "video_id").where("x >= bx0 AND x < bx1 AND y >= by0 AND y < by1")
    step = lambda line, along: F.abs(F.col("gray") - F.lag("gray").over(W.partitionBy("video_id", "t", line).orderBy(along)))
    both = near.withColumn("gx", step("y", "x")).withColumn("gy", step("x", "y"))
    means = both.groupBy("video_id").agg(F.avg("gx").alias("gx"), F.avg("gy").alias("gy"), (F.max("x") - F.min("x") + 1).alias("nx"), (F.max("y") - F.min("y") + 1).alias("ny"))
    return means.select("video_id", F.when((F.col("nx") < 4) | (F.col("ny") < 4), 99.0).otherwise((F.col("gx") + F.col("gy")) / 2).alias("detail"))


def quality_band(detail: Column) -> Column:
    return F.when(detail < 6, "clean").when(detail < 15, "soft").otherwise("too busy")


def _spectrum(a: np.ndarray) -> np.ndarray:
    """The spectrum of a windowed band; half of it, as bands are real."""
    return np.fft.rfft2((a - a.mean()) * np.outer(np.hanning(a.shape[0]), np.hanning(a.shape[1]))).astype(np.complex64)


def _shift(a: np.ndarray, b: np.ndarray, shape: tuple[int, int]) -> tuple[float, float]:
    """(dx, dy) by which b's content lies further right and down than a's, from their spectra, by phase correlation with a parabola at the peak."""
    cross = b * np.conj(a)
    r = np.fft.irfft2(cross / np.maximum(np.abs(cross), 1e-9), shape)
    peak = np.unravel_index(int(r.argmax()), r.shape)
    out = []
    for axis, (k, n) in enumerate(zip(peak, r.shape)):
        line = r[:, peak[1]] if axis == 0 else r[peak[0]]
        at = [line[(k + d) % n] for d in (-1, 0, 1)]
        curve = at[0] - 2 * at[1] + at[2]
        part = 0.5 * (at[0] - at[2]) / curve if curve else 0.0
        out.append((k if k <= n // 2 else k - n) + float(np.clip(part, -0.5, 0.5)))
    return out[1], out[0]


class _Spectra:
    """Spectra of frames' bands: each is made when it is first asked for, and kept while those asked for later fit in a bound."""

    def __init__(self, bands: Callable[[int], np.ndarray], held: int = 96 << 20):
        self._bands, self._held, self._known = bands, held, OrderedDict()

    def __getitem__(self, t: int) -> np.ndarray:
        if t not in self._known:
            self._known[t] = made = _spectrum(self._bands(t))
            while len(self._known) > 2 and len(self._known) * made.nbytes > self._held:
                self._known.popitem(last=False)
        self._known.move_to_end(t)
        return self._known[t]


def _moved(frame: np.ndarray, dx: float, dy: float, box: tuple[int, int, int, int]) -> np.ndarray:
    """The pixels of box (x0, y0, x1, y1) of a frame moved by (-dx, -dy): cubic between pixels, mirrored at the edges."""
    x0, y0, x1, y1 = box
    axes = []
    for n, a, b, d in ((frame.shape[0], y0, y1, dy), (frame.shape[1], x0, x1, dx)):
        at = np.arange(a, b) + d
        base = np.floor(at).astype(int)
        f = at - base
        cubic = [-0.75 * f * (1 - f) ** 2, 1 + f * f * (1.25 * f - 2.25), 1 + (1 - f) ** 2 * (1.25 * (1 - f) - 2.25), -0.75 * f * f * (1 - f)]
        places = np.mod(base + np.arange(-1, 3)[:, None], 2 * n)
        axes.append((cubic, np.where(places >= n, 2 * n - 1 - places, places)))
    (rows, down), (cols, across) = axes
    first = across.min()
    frame = frame[:, first : across.max() + 1]  # no more columns than are asked for
    frame = sum(frame.take(k, axis=0) * c[:, None] for c, k in zip(rows, down))
    return sum(frame.take(k - first, axis=1) * c for c, k in zip(cols, across))


def with_neighbours(frames: DataFrame, boxes: DataFrame, radius: int, chunk: int) -> DataFrame:
    """``frames`` with their video's box and ``part``: a row for each chunk of ``chunk`` frames that a frame is in or within ``radius`` of, from the video's first chunk to its last.

    Boxes, one row a video, are sent to the frames, which stay where they are.
    """
    ends = frames.groupBy("video_id").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    near = F.sequence(F.floor(F.greatest(F.col("t") - radius, "first") / chunk), F.floor(F.least(F.col("t") + radius, "last") / chunk))
    known = frames.where("t IS NOT NULL").join(F.broadcast(boxes.join(ends, "video_id")), "video_id")
    return known.select("video_id", "t", "height", "width", "gray", "x", "y", "w", "h", F.explode(near).alias("part"))


def match_frames(frames: DataFrame, boxes: DataFrame, radius: int = 45, topk: int = 3, chunk: int = 90, ring: int = 18, rebuild: bool = False) -> DataFrame:
    """(video_id, t, matched, source, dx, dy, score, patch) for each frame: what its box hides, taken from frames that show it.

    ``frames(video_id, t, height, width, gray)`` with gray as bytes,
    ``boxes(video_id, x, y, w, h)``. Sources are 3 to ``radius`` frames away,
    nearest first and the earlier of equals; one counts if its content moved by
    half a box at least and its own mark stays off the hole, and the search
    ends with 3 * ``topk`` of them. The score is the mean squared difference on
    a ring around the box; the patch is the median of the ``topk`` best.

    A video is cut into chunks of ``chunk`` frames that get ``radius`` more on
    both sides, so frames are copied two to three times at most and no group
    holds a whole video; a chunk before a video's first frame or after its last
    gets none. A group's frames stay bytes; spectra of their bands are
    kept up to a bound. With ``rebuild`` rows also have height, width and
    ``gray``: the frame with its patch in place, or as it was where nothing
    matched.
    """

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        H, Wd, x, y, bw, bh, part = (int(one[c]) for c in ("height", "width", "x", "y", "w", "h", "part"))
        pics = {int(t): np.frombuffer(g, np.uint8).reshape(H, Wd) for t, g in zip(pdf["t"], pdf["gray"])}
        far = slice(20, H // 2 - 20) if y > H // 2 else slice(H // 2 + 20, H - 20)
        if far.stop - far.start < 8:  # small frames: the half that the box isn't in
            far = slice(0, H // 2) if y > H // 2 else slice(H // 2, H)
        cols = slice(20, Wd - 20) if Wd > 80 else slice(0, Wd)
        x0, y0, x1, y1 = max(0, x - ring), max(0, y - ring), min(Wd, x + bw + ring), min(H, y + bh + ring)
        known = np.ones((y1 - y0, x1 - x0), bool)
        known[y - y0 : y - y0 + bh, x - x0 : x - x0 + bw] = False
        bands = _Spectra(lambda t: pics[t][far, cols].astype(np.float64))
        shape = pics[next(iter(pics))][far, cols].shape
        rows = []
        for t in sorted(t for t in pics if t // chunk == part):
            found = []
            ring_here = pics[t][y0:y1, x0:x1][known].astype(np.float64)
            whole = pics[t].copy() if rebuild else None
            for s in (t + sign * r for r in range(3, radius + 1) for sign in (-1, 1)):
                if s not in pics:
                    continue
                dx, dy = _shift(bands[t], bands[s], shape)
                sx, sy = round(x - dx), round(y - dy)
                hides = abs(dx) < bw / 2 and abs(dy) < bh / 2
                touches = sx <= x + bw and sx + bw >= x and sy <= y + bh and sy + bh >= y
                if hides or touches:
                    continue
                moved = _moved(pics[s], dx, dy, (x0, y0, x1, y1))
                found.append((float(((moved[known] - ring_here) ** 2).mean()), s, dx, dy, moved[y - y0 : y - y0 + bh, x - x0 : x - x0 + bw]))
                if len(found) >= 3 * topk:
                    break
            found.sort(key=lambda f: f[0])
            if found:
                patch = np.clip(np.median([f[4] for f in found[:topk]], axis=0), 0, 255).astype(np.uint8)
                row = (one["video_id"], t, True, found[0][1], found[0][2], found[0][3], found[0][0], patch.tobytes())
                if rebuild:
                    whole[y : y + bh, x : x + bw] = patch.reshape(bh, bw)
            else:
                row = (one["video_id"], t, False, None, None, None, None, None)
            rows.append((*row, H, Wd, whole.tobytes()) if rebuild else row)
        return pd.DataFrame(rows, columns=["video_id", "t", "matched", "source", "dx", "dy", "score", "patch", *(["height", "width", "gray"] if rebuild else [])])

    schema = "video_id long, t int, matched boolean, source int, dx double, dy double, score double, patch binary"
    return with_neighbours(frames, boxes, radius, chunk).groupBy("video_id", "part").applyInPandas(search, schema + (", height int, width int, gray binary" if rebuild else ""))


def rebuilt_frames(frames: DataFrame, boxes: DataFrame, **how) -> DataFrame:
    """(video_id, t, height, width, gray, matched): every frame of ``frames``, with what its box hides put back where that was found.

    Videos without a box are passed on as they are; frames come out by video
    and number when sorted by those.
    """
    plain = frames.join(boxes.select("video_id").distinct(), "video_id", "left_anti").select("video_id", "t", "height", "width", "gray", F.lit(False).alias("matched"))
    made = match_frames(frames, boxes, rebuild=True, **how).select("video_id", "t", "height", "width", "gray", "matched")
    return made.unionByName(plain)


def confidence(matches: DataFrame) -> DataFrame:
    """``matches`` with the confidence of each frame in dB: 0 where none matched."""
    return matches.withColumn("confidence", F.when(F.col("matched"), 10 * F.log10(F.lit(255.0**2) / F.greatest(F.col("score"), F.lit(1e-6)))).otherwise(0.0))


def recovery(matches: DataFrame) -> DataFrame:
    """(video_id, frames, recovered, good, fraction, good_fraction, median_confidence, warn) for each video."""
    n = F.count("*")
    return (
        confidence(matches)
        .groupBy("video_id")
        .agg(n.alias("frames"), F.count_if("matched").alias("recovered"), F.count_if(F.col("confidence") >= 18).alias("good"), (F.count_if("matched") / n).alias("fraction"), (F.count_if(F.col("confidence") >= 18) / n).alias("good_fraction"), F.percentile("confidence", F.lit(0.5)).alias("median_confidence"))
        .withColumn("warn", F.col("good_fraction") < 0.8)
    )
