"""Video geometry: output plans, crops and crop suggestions, as expressions."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasieve.functions.dictionaries import TARGETS
from mediasieve.functions.scalars import even
from mediasieve.operators.grid import targets


def crop_rectangle(w: Column, h: Column, tw: Column, th: Column) -> Column:
    """struct(x, y, w, h, axis) with even sides; axis ``none`` if the ratio is right."""
    want, have = tw / th.cast("double"), w / h.cast("double")
    wide = have > want
    cw, ch = F.when(wide, even(h * want)).otherwise(even(w)), F.when(wide, even(h)).otherwise(even(w / want))
    axis = F.when(F.abs(have - want) < 1e-6, "none").when(wide, "left/right").otherwise("top/bottom")
    return F.struct(F.floor((w - cw) / 2).alias("x"), F.floor((h - ch) / 2).alias("y"), cw.alias("w"), ch.alias("h"), axis.alias("axis"))


def plan_outputs(videos: DataFrame) -> DataFrame:
    """(video_id, label, key, out_w, out_h, chain, note) of each output of ``videos(video_id, src_w, src_h, fit, first_crop)``.

    ``fit`` none scales the whole frame into 1080 x 1920, pad fits it into each
    format with bars, crop cuts each format from the centre. ``first_crop``
    (struct x, y, w, h or null) is cut before and changes the size that plans use.
    """
    sized = videos.withColumn("w", F.coalesce("first_crop.w", "src_w")).withColumn("h", F.coalesce("first_crop.h", "src_h"))
    step = lambda name, *n: F.concat(F.lit(name + "="), F.concat_ws(":", *(x.cast("string") for x in n)))
    scaled = lambda w, h: F.concat(step("scale", w, h), F.lit(":flags=lanczos"))
    first = F.when(F.col("first_crop").isNotNull(), step("crop", F.col("first_crop.w"), F.col("first_crop.h"), F.col("first_crop.x"), F.col("first_crop.y")))
    chained = lambda *steps: F.array_compact(F.array(first, *steps))
    w, h = F.col("w"), F.col("h")
    s = F.least(F.lit(1080) / w, F.lit(1920) / h)
    ow, oh = even(w * s), even(h * s)
    none = sized.where("fit = 'none'").select(
        "video_id", F.lit("native").alias("label"), F.lit("").alias("key"), ow.alias("out_w"), oh.alias("out_h"),
        chained(F.when((ow != w) | (oh != h), scaled(ow, oh))).alias("chain"), F.lit("full frame").alias("note"),
    )
    each = targets(sized.where("fit <> 'none'"))
    tw, th = F.col("tw"), F.col("th")
    s = F.least(tw / w, th / h)
    iw, ih = even(w * s), even(h * s)
    pad = chained(scaled(iw, ih), F.concat(step("pad", tw, th, F.floor((tw - iw) / 2), F.floor((th - ih) / 2)), F.lit(":black")))
    c = crop_rectangle(w, h, tw, th)
    crop = chained(F.when(c["axis"] != "none", step("crop", c["w"], c["h"], c["x"], c["y"])), scaled(tw, th))
    is_pad = F.col("fit") == "pad"
    rest = each.select(
        "video_id", "label", F.col("fmt").alias("key"), tw.cast("long").alias("out_w"), th.cast("long").alias("out_h"),
        F.when(is_pad, pad).otherwise(crop).alias("chain"),
        F.when(is_pad, "padded").when(c["axis"] == "none", "no crop needed").otherwise(F.concat(F.lit("centre-cropped ("), c["axis"], F.lit(")"))).alias("note"),
    )
    return none.unionByName(rest)


def crop_error(box: Column, src_w: Column, src_h: Column) -> Column:
    """An error text for a crop that doesn't lie inside the frame; null if it does."""
    inside = (box["x"] >= 0) & (box["y"] >= 0) & (box["x"] + box["w"] <= src_w) & (box["y"] + box["h"] <= src_h)
    return F.when(box.isNotNull() & ~inside, "crop lies outside the frame")


def suggest_crops(videos: DataFrame) -> DataFrame:
    """(video_id, fmt, label, x, y, w, h, keep_width): for each format the largest crop of its exact ratio that leaves the box out.

    ``videos(video_id, src_w, src_h, box)``. The crop may lie above, below, left
    or right of the box (the first of equals); both of its sides are even. No
    answer gives nulls.
    """
    units = {k: (w // gcd(w, h), h // gcd(w, h)) for k, _, w, h in TARGETS}
    unit = lambda at: F.element_at(F.create_map(*(F.lit(x) for k, u in units.items() for x in (k, u[at]))), F.col("fmt"))
    b, W, H = F.col("box"), F.col("src_w"), F.col("src_h")
    sides = ((W, b["y"], True), (W, H - (b["y"] + b["h"]), True), (b["x"], H, False), (W - (b["x"] + b["w"]), H, False))
    each = targets(videos).withColumn("uw", unit(0)).withColumn("uh", unit(1))
    # The number of units for each side is a column, so that no expression holds it many times.
    units_of = lambda w, h: F.least(F.floor(w / F.col("uw")), F.floor(h / F.col("uh")))
    each = each.withColumns({f"k{order}": units_of(w, h) for order, (w, h, _) in enumerate(sides)})
    options = []
    for order, (w_max, h_max, vertical) in enumerate(sides):
        k = F.col(f"k{order}") - F.col(f"k{order}") % 2  # one unit side of each ratio is odd
        w, h = k * F.col("uw"), k * F.col("uh")
        fits = (w_max >= 32) & (h_max >= 32) & (k > 0) & (w >= 32) & (h >= 32)
        options.append(F.when(fits, F.struct((w * h).alias("area"), F.lit(-order).alias("order"), w.alias("w"), h.alias("h"), F.lit(vertical).alias("vertical"))))
    best = each.withColumn("best", F.array_max(F.array_compact(F.array(*options))))
    w, h, vertical = F.col("best.w"), F.col("best.h"), F.col("best.vertical")
    centred = lambda size, part: F.greatest(F.lit(0), F.least(size - part, F.floor((size - part) / 2)))
    x = F.when(vertical, centred(W, w)).otherwise(F.when(b["x"] >= w, 0).otherwise(W - w))
    y = F.when(vertical, F.when(b["y"] >= h, 0).otherwise(H - h)).otherwise(centred(H, h))
    found = F.col("best").isNotNull()
    long = lambda c: F.when(found, c).cast("long")
    return best.select("video_id", "fmt", "label", long(x).alias("x"), long(y).alias("y"), w.cast("long").alias("w"), h.cast("long").alias("h"), F.bround(F.lit(100.0) * w / W, 1).alias("keep_width"))


def actionable(box_given: Column, accept_detected: bool | Column = False) -> Column:
    """Whether a box may be acted on: given by hand, or a detected one that the caller accepts."""
    return box_given | (accept_detected if isinstance(accept_detected, Column) else F.lit(accept_detected))
