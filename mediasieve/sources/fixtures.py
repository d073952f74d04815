"""Media tables derived from the driver's tables by formulas.

The tables hold no media, so bytes are put together from ids and texts by Spark
expressions; what an operator must find follows from the same ids.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A fixed time (seconds since 1970) that the SQL of ``run_progress`` names.
NOW = 1705363200.0
VARIANTS = ("clean", "comment", "camera", "c2pa", "generator", "xmp", "synthid", "icc")
C2PA = b"jumbc2pa manifest trainedAlgorithmicMedia"
XMP = b"http://ns.adobe.com/xap/1.0/\0<x:xmpmeta/>"
SYNTHID = b"SynthID reference"
ICC = b"ICC_PROFILE\0" + bytes(20)
SOFTWARE = b"ComfyUI 1.0"
SCAN = bytes(range(1, 41))
#: Bytes of a JPEG segment's payload at most.
SEGMENT = 65533


def _tiff(tags: list[tuple[int, bytes | int]]) -> bytes:
    head, extra = struct.pack("<2sHIH", b"II", 42, 8, len(tags)), b""
    after = 10 + 12 * len(tags) + 4
    for tag, value in tags:
        if isinstance(value, int):
            head += struct.pack("<HHII", tag, 4, 1, value)
        else:
            head += struct.pack("<HHII", tag, 2, len(value) + 1, after + len(extra))
            extra += value + b"\0"
    return head + bytes(4) + extra


CAMERA_TIFF = _tiff([(271, b"TestMake"), (272, b"TestModel"), (34853, 8)])
SOFTWARE_TIFF = _tiff([(305, SOFTWARE)])


# Pieces of bytes as SQL text: one expression is parsed instead of thousands of column calls.


def _b(data: bytes) -> str:
    return f"X'{data.hex()}'"


def _n(value: str, size: int, little: bool = False) -> str:
    """An unsigned integer in ``size`` bytes."""
    digits = f"lpad(hex(CAST({value} AS BIGINT)), {2 * size}, '0')"
    if little:
        digits = "concat(" + ", ".join(f"substring({digits}, {2 * k + 1}, 2)" for k in reversed(range(size))) + ")"
    return f"unhex({digits})"


def _cat(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


def _segment(marker: int, payload: str) -> str:
    return _cat(_b(bytes([0xFF, marker])), _n(f"octet_length({payload}) + 2", 2), payload)


def _chunk(kind: bytes, payload: str) -> str:
    body = _cat(_b(kind), payload)
    return _cat(_n(f"octet_length({payload})", 4), body, _n(f"crc32({body})", 4))


def _riff(kind: bytes, payload: str) -> str:
    pad = f"CASE WHEN octet_length({payload}) % 2 = 1 THEN X'00' ELSE X'' END"
    return _cat(_b(kind), _n(f"octet_length({payload})", 4, little=True), payload, pad)


def _box(kind: bytes, payload: str) -> str:
    return _cat(_n(f"octet_length({payload}) + 8", 4), _b(kind), payload)


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, container, variant, note, rel_path, path, width, height, length, content) from ``documents``.

    The embedded note is the whole text, which a JPEG holds in as many comments
    as it takes.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    i = F.col("doc_id")
    note = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x20-\x7e]", "?")
    container = F.element_at(F.array(*map(F.lit, ("jpeg", "png", "webp", "mp4"))), (i % 4 + 1).cast("int"))
    variant = (F.floor(i / 4) % 8).cast("int")
    group = F.floor(i / 32)
    folder = F.element_at(F.array(*map(F.lit, ("reels/", "posts/", "misc/", "stories/day1/", ""))), (group % 5 + 1).cast("int"))
    s = i.cast("string")
    stem = F.element_at(F.array(F.concat(F.lit("shot_"), s), F.concat(F.lit("reel-"), s), F.concat(F.lit("post "), s), F.concat(F.lit("my_reel_"), s), F.lit("x916"), F.lit("grid")), (group % 6 + 1).cast("int"))
    ext = F.element_at(F.array(*map(F.lit, ("jpg", "png", "webp", "mp4"))), (i % 4 + 1).cast("int"))
    typical = F.floor(i / 8) % 2 == 0
    base = docs.select(
        i.alias("media_id"),
        container.alias("container"),
        variant.alias("variant"),
        note.alias("note"),
        F.concat(folder, stem, F.lit("."), ext).alias("rel_path"),
        F.when(typical, 1024).otherwise(640).alias("width"),
        F.when(typical, 1024).otherwise(481).alias("height"),
    )
    w, h, text = "width", "height", "CAST(note AS BINARY)"
    pick = lambda *cases: "CASE variant " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(cases) if c) + " ELSE X'' END"
    piece = _segment(0xFE, f"CAST(substring(note, CAST(k * {SEGMENT} + 1 AS INT), {SEGMENT}) AS BINARY)")
    exif = lambda t: _b(b"Exif\0\0" + t)
    jpeg = _cat(
        _b(b"\xff\xd8"),
        _segment(0xE0, _b(b"JFIF\0\1\1\0\0\1\0\1\0\0")),
        pick(
            None,
            f"aggregate(sequence(0, greatest(length(note) - 1, 0) div {SEGMENT}), X'', (made, k) -> concat(made, {piece}))",
            _segment(0xE1, exif(CAMERA_TIFF)),
            _segment(0xEB, _b(C2PA)),
            _segment(0xE1, exif(SOFTWARE_TIFF)),
            _segment(0xE1, _b(XMP)),
            _segment(0xFE, _b(SYNTHID)),
            _cat(_segment(0xE2, _b(ICC)), _segment(0xE5, _b(bytes(10)))),
        ),
        _segment(0xC0, _cat(_b(b"\x08"), _n(h, 2), _n(w, 2), _b(b"\x03\x01\x11\0\x02\x11\0\x03\x11\0"))),
        _segment(0xDA, _b(b"\x01\x01\0\0\x3f\0")),
        _b(SCAN + b"\xff\xd9"),
    )
    png = _cat(
        _b(b"\x89PNG\r\n\x1a\n"),
        _chunk(b"IHDR", _cat(_n(w, 4), _n(h, 4), _b(b"\x08\x02\0\0\0"))),
        pick(
            None,
            _chunk(b"tEXt", _cat(_b(b"Comment\0"), text)),
            _chunk(b"eXIf", _b(CAMERA_TIFF)),
            _chunk(b"caBX", _b(C2PA)),
            _chunk(b"tEXt", _cat(_b(b"parameters\0"), text)),
            _chunk(b"iTXt", _b(b"XML:com.adobe.xmp\0\0\0\0\0" + XMP.replace(b"\0", b" "))),
            _chunk(b"tEXt", _b(b"Source\0" + SYNTHID)),
            _cat(_chunk(b"iCCP", _b(b"icc\0\0" + bytes(9))), _chunk(b"vpAg", _b(bytes(9)))),
        ),
        _chunk(b"IDAT", _b(SCAN[:20])),
        _chunk(b"IDAT", _b(SCAN[20:])),
        _chunk(b"IEND", _b(b"")),
    )
    flags = "element_at(array(0, 0, 8, 0, 8, 4, 0, 32), variant + 1)"
    webp_body = _cat(
        _riff(b"VP8X", _cat(_n(flags, 1), _b(b"\0\0\0"), _n("width - 1", 3, little=True), _n("height - 1", 3, little=True))),
        pick(None, None, None, None, None, None, None, _riff(b"ICCP", _b(ICC))),
        _riff(b"VP8 ", _b(SCAN[:33])),
        pick(
            None,
            _riff(b"note", text),
            _riff(b"EXIF", _b(CAMERA_TIFF)),
            _riff(b"C2PA", _b(C2PA)),
            _riff(b"EXIF", _b(SOFTWARE_TIFF)),
            _riff(b"XMP ", _b(XMP)),
            _riff(b"note", _b(SYNTHID)),
            None,
        ),
    )
    webp = _cat(_b(b"RIFF"), _n("octet_length(webp_body) + 4", 4, little=True), _b(b"WEBP"), "webp_body")
    uuid = lambda hexed, payload: _box(b"uuid", _cat(_b(bytes.fromhex(hexed)), payload))
    mp4 = _cat(
        _box(b"ftyp", _b(b"isom\0\0\2\0isomiso2")),
        pick(
            None,
            _box(b"moov", _box(b"udta", text)),
            None,
            uuid("d8fec3d61b0e483c92975828877ec481", _b(C2PA)),
            _box(b"moov", _box(b"udta", _b(SOFTWARE))),
            uuid("be7acfcb97a942e89c71999491e3afac", _b(XMP)),
            uuid("00" * 15 + "ff", _b(SYNTHID)),
            _box(b"moov", _cat(_box(b"trak", _box(b"mdia", _box(b"minf", _box(b"stbl", _box(b"stsd", _b(bytes(8) + b"\x0bLavc libx264" + bytes(40))))))), _box(b"udta", _b(b"")))),
        ),
        _box(b"mdat", _b(SCAN)),
    )
    made = base.withColumn("webp_body", F.expr(f"CASE WHEN container = 'webp' THEN {webp_body} END"))
    content = F.expr(f"CASE container WHEN 'jpeg' THEN {jpeg} WHEN 'png' THEN {png} WHEN 'webp' THEN {webp} ELSE {mp4} END")
    path = F.concat(F.lit("/media/"), F.col("media_id").cast("string"), F.lit("/"), F.col("rel_path"))
    return made.withColumn("content", content).drop("webp_body").withColumn("length", F.length("content").cast("long")).withColumn("path", path)


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, rel_path, content, probe_json) of videos from ``documents``: MP4, WebM and MOV by id, with the whole text as a comment tag of most."""
    i, k = F.col("doc_id"), F.col("doc_id") % 5
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    note = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x20-\x7e]", "?")
    rel = F.concat(i.cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, ("mp4", "webm", "mov"))), (i % 3 + 1).cast("int")))
    iso = F.expr(_cat(_box(b"ftyp", _b(b"isom\0\0\2\0isomiso2")), _box(b"moov", _box(b"udta", _b(b"plain"))), _box(b"mdat", _b(SCAN))))
    webm = F.lit(b"\x1a\x45\xdf\xa3\x9fB\x86\x81\x01webm")
    tags = lambda *kv: F.create_map(*(x for a, b in kv for x in (F.lit(a), b)))
    encoder = F.when(k == 1, "Sora export").otherwise("Lavc libx264")
    container_tags = F.when(k == 4, tags(("major_brand", F.lit("isom")))).otherwise(tags(("comment", note), ("major_brand", F.lit("isom"))))
    stream_tags = F.when(k.isin(1, 2), tags(("handler_name", F.lit("v")), ("encoder", encoder))).otherwise(tags(("handler_name", F.lit("v"))))
    video = F.struct(F.lit("video").alias("codec_type"), F.lit("h264").alias("codec_name"), F.when(k == 3, 1024).otherwise(1000).alias("width"), F.when(k == 3, 1024).otherwise(700).alias("height"), F.lit("25/1").alias("avg_frame_rate"), stream_tags.alias("tags"))
    probe = F.to_json(F.struct(F.struct(F.lit("4.0").alias("duration"), container_tags.alias("tags")).alias("format"), F.array(video).alias("streams")))
    return docs.select(F.concat(F.lit("/clips/"), rel).alias("path"), rel.alias("rel_path"), F.when(i % 3 == 1, webm).otherwise(iso).alias("content"), probe.alias("probe_json"))


def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, axis, pos, mean, std) of made-up 2 x 2 grids from ``part``: gutters of many places and thicknesses, or none."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("image_id"), F.col("p_size").alias("s"))
    axes = part.select("image_id", "s", F.explode(F.array(F.lit(0), F.lit(1))).alias("axis")).withColumn("length", F.col("s") + 48 + 5 * F.col("axis"))
    lines = axes.select("*", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("pos"))
    begin = F.floor(F.col("length") / 2) - 6 + F.col("s") % 13
    thick = F.col("s") % 7
    border = F.col("s") % 4
    white = (F.col("pos") < border) | (F.col("pos") >= F.col("length") - border) | ((F.col("pos") >= begin) & (F.col("pos") < begin + thick))
    return lines.select(
        "image_id",
        "axis",
        "pos",
        F.when(white, 250.0).otherwise(((7 * F.col("pos") + F.col("image_id")) % 200).cast("double")).alias("mean"),
        F.when(white, F.when(F.col("s") % 11 == 0, 7.0).otherwise(2.0)).otherwise(30.0).alias("std"),
    )


def panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(panel_id, w, h) of many shapes from ``part``."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    return part.select(k.alias("panel_id"), (k * 37 % 900 + 10).cast("int").alias("w"), (k * 53 % 1100 + 10).cast("int").alias("h"))


def video_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, src_w, src_h, box_text, fit, probe_json) from ``orders``."""
    k = F.col("o_orderkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k)
    sizes = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in ((1920, 1080), (1080, 1920), (1280, 720), (721, 1281), (1080, 1350), (640, 481))))
    at = F.element_at(sizes, (k % 6 + 1).cast("int"))
    box = F.concat_ws(":", k % 500, k * 3 % 400, k % 90 + 10, k % 70 + 10)
    text = F.when(k % 17 == 0, F.concat(F.lit("bad:"), k.cast("string"))).when(k % 23 == 0, F.translate(box, ":", ",")).when(k % 29 == 0, F.concat_ws(":", k % 500, F.lit(5), F.lit(0), F.lit(9))).otherwise(box)
    fps = F.when(k % 19 == 0, "0/0").when(k % 5 == 0, "30000/1001").otherwise("25/1")
    probe_json = F.format_string(
        '{"format":{"duration":"%s","tags":{"title":"clip %d","major_brand":"isom"}},"streams":[{"codec_type":"audio","codec_name":"aac"},{"codec_type":"video","codec_name":"h264","width":%d,"height":%d,"avg_frame_rate":"%s","tags":{"handler_name":"v","encoder":"x"}}]}',
        F.when(k % 13 == 0, "N/A").otherwise((k % 60).cast("string")), k, at["w"], at["h"], fps,
    )
    fit = F.element_at(F.array(*map(F.lit, ("none", "pad", "crop"))), (k % 3 + 1).cast("int"))
    return orders.select(k.alias("video_id"), at["w"].alias("src_w"), at["h"].alias("src_h"), text.alias("box_text"), fit.alias("fit"), probe_json.alias("probe_json"))


#: Videos whose frames, and pictures that, lie in one partition.
_TOGETHER, _PICTURES_TOGETHER = 256, 2048


def _dealt(rows: DataFrame, key: str, together: int) -> DataFrame:
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // together)), key)


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id) from ``supplier``, dealt by video while rows are small: the frames made from them lie by video, and what groups or joins them by it moves none."""
    videos = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("video_id"))
    return _dealt(videos, "video_id", _TOGETHER)


def frame_pixels(spark: SparkSession, sf_dir: str, n_frames: int = 4) -> DataFrame:
    """(video_id, t, y, x, gray) of small clips from ``supplier``: a moving picture with a still, bright mark in one corner of most."""
    k = F.col("s_suppkey")
    videos = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("video_id"))
    grid = (
        videos.select("video_id", F.explode(F.sequence(F.lit(0), F.lit(n_frames - 1))).alias("t"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(95))).alias("y"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(127))).alias("x"))
    )
    c = F.col("video_id") % 6  # corners 0 to 3, no mark, a mark that is too long
    wide = F.when(c == 5, 30).otherwise(8)
    left = F.when(c.isin(1, 3), 128 - 14).otherwise(4)
    top = F.when(c.isin(2, 3), 96 - 14).otherwise(4)
    mark = (c != 4) & F.col("x").between(left, left + wide - 1) & F.col("y").between(top, top + 7)
    moving = (F.col("x") * 7 + F.col("y") * 13 + F.col("t") * (F.col("video_id") % 5 + 11)) % 160
    return grid.select("video_id", "t", "y", "x", F.when(mark, 230.0).otherwise(moving.cast("double")).alias("gray"))


def frame_clips(spark: SparkSession, sf_dir: str, n_frames: int = 24) -> DataFrame:
    """(video_id, t, height, width, gray) of the clips of ``frame_pixels``, a frame as bytes."""
    clips = _videos(spark, sf_dir).select("video_id", (F.col("video_id") % 6).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(n_frames - 1))).alias("t"))
    # Row y of a frame begins with (13 * y + p) % 160, and 13 * 37 % 160 is 1: a frame is 96 rows of one strip, from its row 37 * p % 160 on.
    strip = b"".join(bytes((7 * x + 13 * k) % 160 for x in range(128)) for k in range(160 + 95))
    first = "37 * t * (video_id % 5 + 11) % 160 * 128 + 1"
    wide, left, top = "CASE WHEN c = 5 THEN 30 ELSE 8 END", "CASE WHEN c IN (1, 3) THEN 114 ELSE 4 END", "CASE WHEN c IN (2, 3) THEN 82 ELSE 4 END"
    placed = clips.select("*", F.lit(strip).alias("strip"), *(F.expr(f"CAST({e} AS INT)").alias(n) for n, e in (("first", first), ("wide", wide), ("at", f"128 * ({top}) + {left}"))))
    # The frame up to the mark, the mark's eight rows with what lies between them, and the rest.
    mark = f"substring(X'{'e6' * 30}', 1, wide)"
    between = "substring(strip, first + at + wide + 128 * {0}, 128 - wide)"
    marked = ", ".join(["substring(strip, first, at)", *(e for k in range(7) for e in (mark, between.format(k))), mark, "substring(strip, first + at + wide + 896, 12288 - 896 - at - wide)"])
    frame = f"CASE WHEN c <> 4 THEN concat({marked}) ELSE substring(strip, first, 12288) END"
    return placed.select("video_id", "t", F.lit(96).alias("height"), F.lit(128).alias("width"), F.expr(frame).alias("gray"))


def epoch_seconds(column: str) -> Column:
    """Seconds since 1970 of a timestamp without a time zone, whatever the session's."""
    return F.expr(f"CAST(CAST({column} - TIMESTAMP_NTZ'1970-01-01 00:00:00' AS INTERVAL SECOND) AS DECIMAL(20, 6))").cast("double")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, created, mtime, run_id, name, failed) from ``events``; every 31st job's folder is missing (mtime null)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    created = epoch_seconds("ts")
    return events.select(
        F.col("event_id").alias("job_id"),
        created.alias("created"),
        F.when(F.col("event_id") % 31 != 0, created + F.col("value") * 60).alias("mtime"),
        F.col("user_id").alias("run_id"),
        F.concat(F.lit("file_"), F.col("event_id").cast("string"), F.lit(".png")).alias("name"),
        (F.col("event_type") == "error").alias("failed"),
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch, ord, name, rel) from ``pages``: names that repeat, differ by case alone or look like generated ones."""
    k = F.col("page_id")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(k)
    n = F.floor(k / 7) % 9
    name = F.when(n == 0, "shot.jpg").when(n == 1, "SHOT.jpg").when(n == 2, "shot_1.jpg").when(n == 3, "notes.txt").when(n == 4, "").when(n == 5, F.concat(F.lit("clip"), (k % 5).cast("string"), F.lit(".mp4"))).when(n == 6, "dir/photo.png").otherwise(F.concat(F.lit("img"), k.cast("string"), F.lit(".webp")))
    rel = F.when(k % 5 == 0, "../secret.txt").when(k % 5 == 1, "ok/a.png").when(k % 5 == 2, "/etc/x").when(k % 5 == 3, "a/../../b.png").otherwise("a/./../c.png")
    return pages.select((k % 7).alias("batch"), k.alias("ord"), name.alias("name"), rel.alias("rel"))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, height, width, rgb) of small 2 x 2 grid pictures from ``part``, white where ``line_stats`` has white lines."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    sized = part.select(F.col("p_partkey").alias("image_id"), F.col("p_partkey").cast("string").alias("path"), F.col("p_size").alias("s"), (F.col("p_size") + 48).alias("height"), (F.col("p_size") + 53).alias("width"))
    sized = _dealt(sized, "path", _PICTURES_TOGETHER)  # while rows are small: the pictures lie by path
    white_y = "y < s % 4 OR y >= height - s % 4 OR (y >= height div 2 - 6 + s % 13 AND y < height div 2 - 6 + s % 13 + s % 7)"
    # A row of the picture: border, left panel, gutter, right panel, border; three pairs of digits a pixel.
    gray = "repeat(lpad(hex((13 * y + image_id) % 200), 2, '0'), 3)"
    left, right = "width div 2 - 6 + s % 13 - s % 4", "width - width div 2 + 6 - s % 13 - s % 7 - s % 4"
    row = f"concat(repeat('ffffff', s % 4), repeat({gray}, {left}), repeat('ffffff', s % 7), repeat({gray}, {right}), repeat('ffffff', s % 4))"
    rows = f"transform(sequence(0, height - 1), y -> CASE WHEN {white_y} THEN repeat('ffffff', width) ELSE {row} END)"
    return sized.select("path", "height", "width", F.expr(f"unhex(array_join({rows}, ''))").alias("rgb"))


#: Place and size of the still mark of ``pan_frames``.
MARK = (90, 70, 14, 12)


def pan_frames(spark: SparkSession, sf_dir: str, n_frames: int = 12) -> DataFrame:
    """(video_id, t, height, width, gray) of clips from ``supplier``: a smooth picture that moves 3 to 5 pixels a frame under a still mark.

    A frame depends only on how far the picture has moved, at most 3 x
    ``n_frames`` distances: each is drawn once and sent to the frames that
    show it.
    """
    x0, y0, w, h = MARK
    clips = _videos(spark, sf_dir).select("video_id", F.explode(F.sequence(F.lit(0), F.lit(n_frames - 1))).alias("t"))
    clips = clips.withColumn("moved", F.expr("t * (3 + video_id % 3)"))
    at = "(p % 128 + moved)"
    wave = f"128 + 50 * sin({at} * 0.13 + (p div 128) * 0.21) + 40 * sin({at} * 0.071 - (p div 128) * 0.11) + 25 * cos({at} * 0.31 + (p div 128) * 0.017 * {at} * 0.05)"
    mark = f"p % 128 BETWEEN {x0} AND {x0 + w - 1} AND p div 128 BETWEEN {y0} AND {y0 + h - 1}"
    gray = f"unhex(array_join(transform(sequence(0, 12287), p -> lpad(hex(CASE WHEN {mark} THEN 250 ELSE CAST({wave} AS INT) END), 2, '0')), ''))"
    drawn = clips.select("moved").distinct().withColumn("gray", F.expr(gray))
    return clips.join(F.broadcast(drawn), "moved").select("video_id", "t", F.lit(96).alias("height"), F.lit(128).alias("width"), "gray")
