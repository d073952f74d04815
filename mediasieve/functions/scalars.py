"""Column functions: names, numbers, boxes and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediasieve.functions.dictionaries import FOLDERS_45, FOLDERS_916, IMAGE_EXTENSIONS, NAME_45, NAME_916, READABLE, VIDEO_EXTENSIONS


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    """All before the last slash; empty without one."""
    return F.regexp_extract(path, r"^(?s:(.*))/", 1)


def extension(path: Column) -> Column:
    """Lower case, without the dot; empty for names without one or with a dot at their start alone."""
    return F.lower(F.regexp_extract(base_name(path), r"^(?s:.+)\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    name = base_name(path)
    cut = F.regexp_extract(name, r"^(?s:(.+))\.[^.]*$", 1)
    return F.when(cut == "", name).otherwise(cut)


def media_kind(path: Column) -> Column:
    """image, video or null, by extension."""
    ext = extension(path)
    return F.when(ext.isin(*IMAGE_EXTENSIONS), "image").when(ext.isin(*VIDEO_EXTENSIONS), "video")


def joined_path(*parts: Column) -> Column:
    """Parts joined by slashes; empty parts are left out."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "/")


def human_size(n: Column) -> Column:
    """Bytes as text: one decimal below 10 units, none above."""
    n = n.cast("double")
    unit = F.when(n < 1024**2, F.struct((n / 1024).alias("x"), F.lit("KB").alias("u"))).when(n < 1024**3, F.struct((n / 1024**2).alias("x"), F.lit("MB").alias("u"))).otherwise(F.struct((n / 1024**3).alias("x"), F.lit("GB").alias("u")))
    # format_string rounds halves up; rounding half to even comes first.
    shown = F.when(unit.x < 10, F.format_string("%.1f %s", F.bround(unit.x, 1), unit.u)).otherwise(F.format_string("%.0f %s", F.bround(unit.x), unit.u))
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).otherwise(shown)


def short_error(message: Column, type_name: Column) -> Column:
    """A message for users: nothing from ``Traceback`` on, 280 characters at most, the type's name if empty."""
    text = F.trim(F.coalesce(message, F.lit("")))
    text = F.when(text == "", type_name).otherwise(text)
    head = F.trim(F.substring_index(text, "Traceback", 1))
    text = F.when(F.contains(text, F.lit("Traceback")), F.when(head == "", F.lit("Processing failed.")).otherwise(head)).otherwise(text)
    return F.when(F.length(text) > 280, F.concat(F.substring(text, 1, 277), F.lit("…"))).otherwise(text)


def even(n: Column) -> Column:
    """Rounded half to even, then down to an even number."""
    whole = F.bround(n).cast("long")
    return whole - F.pmod(whole, F.lit(2))


def box_text(box: Column) -> Column:
    return F.concat_ws(":", box["x"], box["y"], box["w"], box["h"])


def parse_box(text: Column) -> tuple[Column, Column]:
    """(box struct or null, error or null) of ``x:y:w:h`` with colons or commas."""
    parts = F.split(F.translate(text, ",", ":"), ":")
    numbers = F.transform(parts, lambda p: F.trim(p).try_cast("int"))
    bad = F.when(text.isNull() | (F.size(parts) != 4), "expected x:y:w:h").when(F.exists(numbers, lambda x: x.isNull()), "not a whole number").when((numbers[2] <= 0) | (numbers[3] <= 0), "width and height must be positive")
    box = F.struct(*(F.get(numbers, F.lit(k)).alias(c) for k, c in enumerate("xywh")))
    return F.when(bad.isNull(), box), bad


def escapes(rel: Column) -> Column:
    """Whether a relative path leaves its base: absolute, or more steps up than down at some place."""
    step = lambda p: F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"))
    walked = F.aggregate(F.split(rel, "/"), start, lambda a, p: F.struct((a.depth + step(p)).alias("depth"), F.least(a.low, a.depth + step(p)).alias("low")))
    return F.startswith(rel, F.lit("/")) | (walked.low < 0)


def route(path: Column, flag: str | None = None) -> tuple[Column, Column]:
    """(formats array, reason): by flag, the file's name, its folders, or both formats."""
    both = F.array(F.lit("45"), F.lit("916"))
    if flag:
        return (both if flag == "both" else F.array(F.lit(flag))), F.lit(f"--format {flag}")
    name, folders = stem(path), F.split(F.lower(folder(path)), "/")
    tall, near = name.rlike(NAME_916), name.rlike(NAME_45)
    in_tall = F.arrays_overlap(folders, F.array(*map(F.lit, FOLDERS_916)))
    in_near = F.arrays_overlap(folders, F.array(*map(F.lit, FOLDERS_45)))
    one = lambda f: F.array(F.lit(f))
    hit = lambda p: F.concat(F.lit("filename matched '"), F.regexp_extract(name, p, 0), F.lit("'"))
    formats = F.when(tall & ~near, one("916")).when(near & ~tall, one("45")).when(tall & near, both).when(in_tall, one("916")).when(in_near, one("45")).otherwise(both)
    reason = F.when(tall & ~near, hit(NAME_916)).when(near & ~tall, hit(NAME_45)).when(tall & near, F.lit("filename matched both tokens")).when(in_tall | in_near, F.lit("input subfolder")).otherwise(F.lit("default"))
    return formats, reason


def readable_runs(payload: Column, least: int, limit: int, separator: str) -> Column:
    """The longest readable runs of binary data, longest first and then in order, joined."""
    runs = F.regexp_extract_all(F.decode(payload, "ISO-8859-1"), F.lit(READABLE + "{%d,}" % least), F.lit(0))
    ranked = F.array_sort(F.transform(runs, lambda r, k: F.struct((-F.length(r)).alias("size"), k.alias("k"), r.alias("r"))))
    return F.array_join(F.transform(F.slice(ranked, 1, limit), lambda s: s.r), separator)
