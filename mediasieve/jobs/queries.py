"""The registered queries of the media library and, where SQL can say it, what they must return.

Media are fixtures derived from the given tables; the SQL works from the same
ids and texts and never parses bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasieve.functions import scalars as S
from mediasieve.functions.dictionaries import GENERATOR_NAMES, LEFTOVER_SIGNATURES, SIGNATURES
from mediasieve.jobs import grids, reports
from mediasieve.operators import clean, findings, frames, grid, naming, origin, video
from mediasieve.operators.records import sniff, walk, walk_files
from mediasieve.sources import fixtures as X
from mediasieve.sources import media as M
from mediasieve.sources.listing import list_all, list_files, list_unsupported
from mediasieve.sources.pieces import publish
from mediasieve.sources.shared import checkpointed, fresh_folder
from mediasieve.streaming import files as streams


def _id():
    return F.regexp_extract("path", r"^/media/(\d+)/", 1).cast("long").alias("media_id")


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    audited = reports.audit(X.media(spark, sf_dir))
    return audited.withColumn("folder", S.folder(F.col("rel_path"))).withColumn("kind", S.media_kind(F.col("rel_path"))).withColumn("media_id", _id())


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """The files below a folder by ``<number>/<folder>/<media id>~<name>``, listed once."""
    listed = checkpointed(list_files(spark, root))
    media_id = F.regexp_extract("rel_path", r"(\d+)~[^/]*$", 1).cast("long")
    return listed.withColumn("media_id", media_id).withColumn("rel_path", F.regexp_replace("rel_path", r"^\d+/(.*/)?\d+~", "$1"))


def _numbered_path():
    folder = S.folder(F.col("rel_path"))
    return F.concat((F.col("media_id") % 8).cast("string"), F.lit("/"), F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), F.col("media_id").cast("string"), F.lit("~"), S.base_name(F.col("rel_path")))


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media fixture as files in the shared folder, listed again: they are found, opened and read by path."""
    root = fresh_folder(spark, "media")
    publish(X.media(spark, sf_dir).select("path", _numbered_path().alias("out_path"), "content"), root)
    return _listed(spark, root)


# --- what the fixtures hold, as SQL -----------------------------------------

_T, _C, _S, _P = len(X.CAMERA_TIFF), len(X.C2PA), len(X.SOFTWARE_TIFF), len(X.XMP)
_Y, _I = len(X.SYNTHID), len(X.ICC)
#: (container number, variant, kind, label, bytes, how many times the note's length is added)
_FOUND = [
    (0, 1, "segment", "COM (comment)", 4, 1), (0, 1, "info", "info: comment", 0, 1),
    (0, 2, "segment", "APP1 (EXIF / XMP)", 10 + _T, 0), (0, 2, "info", "info: exif", 6 + _T, 0),
    (0, 3, "segment", "APP11 (JUMBF (C2PA))", 4 + _C, 0),
    (0, 4, "segment", "APP1 (EXIF / XMP)", 10 + _S, 0), (0, 4, "info", "info: exif", 6 + _S, 0),
    (0, 5, "segment", "APP1 (EXIF / XMP)", 4 + _P, 0), (0, 5, "info", "info: xmp", _P, 0),
    (0, 6, "segment", "COM (comment)", 4 + _Y, 0), (0, 6, "info", "info: comment", _Y, 0),
    (0, 7, "segment", "APP2 (ICC profile / MPF)", 4 + _I, 0), (0, 7, "info", "info: icc_profile", _I, 0), (0, 7, "segment", "APP5 (application)", 14, 0),
    (1, 1, "chunk", "tEXt chunk (text)", 20, 1),
    (1, 2, "chunk", "eXIf chunk (EXIF)", 12 + _T, 0), (1, 2, "info", "info: exif", _T, 0),
    (1, 3, "chunk", "caBX chunk (C2PA (JUMBF))", 12 + _C, 0),
    (1, 4, "chunk", "tEXt chunk (text)", 23, 1),
    (1, 5, "chunk", "iTXt chunk (international text / XMP)", 34 + _P, 0), (1, 5, "info", "info: xmp", 22 + _P, 0),
    (1, 6, "chunk", "tEXt chunk (text)", 19 + _Y, 0),
    (1, 7, "chunk", "iCCP chunk (ICC profile)", 26, 0), (1, 7, "info", "info: icc_profile", 14, 0), (1, 7, "chunk", "vpAg chunk", 21, 0),
    (2, 2, "chunk", "EXIF chunk", 8 + _T, 0), (2, 2, "info", "info: exif", _T, 0),
    (2, 4, "chunk", "EXIF chunk", 8 + _S, 0), (2, 4, "info", "info: exif", _S, 0),
    (2, 5, "chunk", "XMP  chunk", 8 + _P, 0), (2, 5, "info", "info: xmp", _P, 0),
    (2, 7, "chunk", "ICCP chunk", 8 + _I, 0), (2, 7, "info", "info: icc_profile", _I, 0),
    (3, 1, "box", "udta box", 8, 1),
    (3, 3, "box", "C2PA / Content Credentials manifest", 24 + _C, 0),
    (3, 4, "box", "udta box", 8 + len(X.SOFTWARE), 0),
    (3, 5, "box", "XMP packet", 24 + _P, 0),
    (3, 6, "box", "unknown uuid box (0000000000000000)", 24 + _Y, 0),
    (3, 7, "box", "udta box", 8, 0),
]
for _c in range(4):
    _FOUND += [(_c, 3, "signature", label, 0, 0) for label in ("C2PA claim data", "JUMBF box (C2PA container)", "C2PA assertion: AI-generated")]
    _FOUND += [(_c, 5, "signature", "XMP packet", 0, 0), (_c, 6, "signature", "SynthID reference", 0, 0)]

#: A JPEG holds a note in as many comments as it takes (p: the pieces of the notes that are stored as text).
_MEDIA_SQL = rf"""
m AS (
  SELECT doc_id AS media_id, doc_id % 4 AS c, (doc_id // 4) % 8 AS v, regexp_replace(coalesce(text, ''), '[^\x20-\x7e]', '?', 'g') AS note,
    (doc_id // 8) % 2 = 0 AS typical,
    ['reels', 'posts', 'misc', 'stories/day1', ''][(doc_id // 32) % 5 + 1] AS folder,
    ['shot_' || doc_id, 'reel-' || doc_id, 'post ' || doc_id, 'my_reel_' || doc_id, 'x916', 'grid'][(doc_id // 32) % 6 + 1] AS stem,
    ['jpg', 'png', 'webp', 'mp4'][doc_id % 4 + 1] AS ext,
    CASE WHEN doc_id % 4 = 3 THEN 'video' ELSE 'image' END AS kind
  FROM documents
), p AS (
  SELECT media_id, c, v, CASE WHEN c = 0 THEN list_transform(range(0, greatest(1, (length(note) + {X.SEGMENT - 1}) // {X.SEGMENT})), lambda i: substring(note, CAST(i * {X.SEGMENT} + 1 AS BIGINT), {X.SEGMENT})) ELSE [note] END AS pieces
  FROM m WHERE v = 1 OR (v = 4 AND c = 1)
)"""
_FOUND_SQL = (
    _MEDIA_SQL
    + ", k(c, v, kind, label, fixed, per) AS (VALUES "
    + ", ".join(f"({c}, {v}, '{kind}', '{label}', {fixed}, {per})" for c, v, kind, label, fixed, per in _FOUND)
    + "), f0 AS (SELECT m.media_id, k.kind, k.label, CAST(k.fixed + k.per * length(m.note) AS BIGINT) AS nbytes FROM m JOIN k ON m.c = k.c AND m.v = k.v WHERE k.kind <> 'info' OR k.fixed + k.per * length(m.note) > 0)"
    + ", sig(s, label) AS (VALUES "
    + ", ".join(f"('{s}', '{label}')" for s, label in SIGNATURES)
    + """), f AS (
  SELECT * FROM f0 WHERE label <> 'COM (comment)' OR media_id NOT IN (SELECT media_id FROM p WHERE c = 0)
  UNION ALL SELECT media_id, 'segment', 'COM (comment)', CAST(4 + length(piece) AS BIGINT) FROM (SELECT media_id, unnest(pieces) AS piece FROM p WHERE c = 0)
  UNION ALL SELECT media_id, 'signature', sig.label, CAST(0 AS BIGINT) FROM p JOIN sig ON len(list_filter(pieces, lambda t: contains(lower(t), sig.s))) > 0
)"""
)
_NAMED = "len(list_filter([" + ", ".join(f"'{n}'" for n in GENERATOR_NAMES) + "], lambda n: contains(lower(note), n))) > 0"
_O_SQL = f""", o AS (
  SELECT *, CASE
      WHEN v = 3 OR (v = 4 AND c < 3) OR (c = 1 AND v = 1 AND {_NAMED}) THEN 'ai-declared'
      WHEN typical AND ((v = 0 AND c < 3) OR (c = 2 AND v = 1)) THEN 'ai-likely'
      WHEN v = 2 AND c < 3 THEN 'camera-like' ELSE 'unknown' END AS verdict,
    CASE WHEN v = 6 THEN 'declared' ELSE 'not-declared' END AS synthid
  FROM m
)"""
_VERDICT_SQL = _MEDIA_SQL + _O_SQL
_REL = "concat(CASE WHEN folder = '' THEN '' ELSE folder || '/' END, stem, '.', ext)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- inspection and origin ---------------------------------------------------


@query(f"WITH {_VERDICT_SQL} SELECT folder, kind, verdict, count(*) AS files, CAST(grouping(folder, kind, verdict) AS BIGINT) AS level FROM o GROUP BY ROLLUP (folder, kind, verdict)")
def verdict_rollup(spark, sf_dir):
    return reports.verdict_rollup(_audited(spark, sf_dir))


@query(f"WITH {_VERDICT_SQL} SELECT media_id, verdict, synthid FROM o")
def origin_verdicts(spark, sf_dir):
    return _audited(spark, sf_dir).select("media_id", "verdict", "synthid")


_TEXTS = "CASE verdict " + " ".join(f"WHEN '{code}' THEN '{text}'" for code, text, _ in origin.VERDICTS) + " END"
_NOTES = {"declared": "A pixel watermark is declared; it stays", "hidden": "No pixel watermark is declared, which does not mean", "open": "No pixel watermark is declared; only its maker"}


@query(f"""WITH {_VERDICT_SQL} SELECT media_id, {_TEXTS} AS headline,
  CASE WHEN synthid = 'declared' THEN '{_NOTES["declared"]}' WHEN c = 3 OR verdict = 'ai-declared' THEN '{_NOTES["hidden"]}' ELSE '{_NOTES["open"]}' END AS note FROM o""")
def origin_texts(spark, sf_dir):
    """Headline of each verdict, and the beginning of what is said of pixel watermarks."""
    note = F.coalesce(*(F.when(F.startswith("synthid_note", F.lit(n)), n) for n in _NOTES.values()))
    return _audited(spark, sf_dir).select("media_id", "headline", note.alias("note"))


_EVIDENCE_SQL = f"""WITH {_MEDIA_SQL} SELECT media_id, e.weight, e.label FROM m JOIN (VALUES
  ('declared', 'C2PA assertion: trainedAlgorithmicMedia', 1), ('declared', 'C2PA / Content Credentials manifest', 2), ('camera', 'Camera capture data present', 3),
  ('declared', 'Generation record embedded', 4), ('circumstantial', 'Size typical of a generator', 5), ('circumstantial', 'No metadata at all', 6)) AS e(weight, label, k)
ON CASE e.k WHEN 1 THEN v = 3 WHEN 2 THEN v = 3 AND c IN (1, 3) WHEN 3 THEN v = 2 AND c < 3 WHEN 4 THEN v = 4 AND c = 1 WHEN 5 THEN typical AND c < 3 AND v <> 2 ELSE (v = 0 AND c < 3) OR (v = 1 AND c = 2) END"""
# A PNG's text is searched twice: as a value, and as the two longest readable runs of its chunk.
_EVIDENCE_SQL += rf""" UNION ALL SELECT media_id, 'declared', 'Generator named in metadata' FROM (
  SELECT media_id, note FROM m WHERE c = 1 AND v IN (1, 4)
  UNION ALL SELECT media_id, '{X.SOFTWARE.decode()}' FROM m WHERE v = 4 AND c IN (0, 2)
  UNION ALL SELECT media_id, string_agg(r, ' ' ORDER BY n) FROM (
    SELECT media_id, r, row_number() OVER (PARTITION BY media_id ORDER BY length(r) DESC, k) AS n FROM (
      SELECT media_id, unnest(runs) AS r, generate_subscripts(runs, 1) AS k FROM (
        SELECT media_id, regexp_extract_all(CASE v WHEN 1 THEN 'Comment?' ELSE 'parameters?' END || note, '[A-Za-z0-9 ._:/@{{}}"''\[\],-]{{4,}}') AS runs FROM m WHERE c = 1 AND v IN (1, 4)))) WHERE n <= 2 GROUP BY 1
) WHERE {_NAMED}"""


@query(_EVIDENCE_SQL)
def evidence_flat(spark, sf_dir):
    return _audited(spark, sf_dir).select("media_id", F.explode("evidence").alias("e")).select("media_id", "e.weight", "e.label")


@query(f"WITH {_FOUND_SQL}{_O_SQL} SELECT o.media_id, o.verdict, CAST(count(f.media_id) AS BIGINT) AS n_findings FROM o LEFT JOIN f ON o.media_id = f.media_id GROUP BY 1, 2")
def json_reports(spark, sf_dir):
    texts = reports.as_json(_audited(spark, sf_dir)).withColumn("media_id", _id())
    return texts.select("media_id", F.get_json_object("report", "$.verdict").alias("verdict"), F.json_array_length(F.get_json_object("report", "$.findings")).alias("n_findings"))


@query(f"WITH {_MEDIA_SQL} SELECT media_id, CASE c WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' ELSE 'iso' END AS container FROM m")
def sniffed_containers(spark, sf_dir):
    return X.media(spark, sf_dir).select("media_id", sniff(F.col("content")).alias("container"))


@query(f"WITH {_FOUND_SQL} SELECT media_id, kind, label, nbytes FROM f")
def findings_flat(spark, sf_dir):
    return findings.exploded(findings.with_findings(walk(X.media(spark, sf_dir)))).select(_id(), "kind", "label", "nbytes")


@query(f"WITH {_FOUND_SQL} SELECT kind, label, count(DISTINCT media_id) AS files, count(*) AS occurrences, CAST(sum(nbytes) AS BIGINT) AS nbytes FROM f GROUP BY 1, 2")
def findings_by_label(spark, sf_dir):
    return reports.findings_by_label(findings.exploded(findings.with_findings(walk(X.media(spark, sf_dir)))))


@query(f"WITH {_FOUND_SQL} SELECT m.kind, count(*) AS files, count(*) FILTER (m.media_id IN (SELECT media_id FROM f)) AS with_findings FROM m GROUP BY 1")
def batch_overview(spark, sf_dir):
    return reports.overview(_audited(spark, sf_dir))


@query(f"WITH {_MEDIA_SQL} SELECT media_id, CASE WHEN c = 3 THEN 0 WHEN typical THEN 1024 ELSE 640 END AS width, CASE WHEN c = 3 THEN 0 WHEN typical THEN 1024 ELSE 481 END AS height FROM m")
def header_sizes(spark, sf_dir):
    return walk(X.media(spark, sf_dir)).select(_id(), F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height"))


@query(f"WITH {_MEDIA_SQL} SELECT media_id, CASE v WHEN 1 THEN 'Comment' WHEN 4 THEN 'parameters' WHEN 5 THEN 'XML:com.adobe.xmp' ELSE 'Source' END AS key, CASE v WHEN 5 THEN '{X.XMP.decode().replace(chr(0), ' ')}' WHEN 6 THEN 'SynthID reference' ELSE note END AS value FROM m WHERE c = 1 AND v IN (1, 4, 5, 6)")
def png_texts(spark, sf_dir):
    walked = walk(X.media(spark, sf_dir)).where("container = 'png'")
    return walked.select(_id(), F.explode("text_kv").alias("key", "value"))


@query(f"WITH {_MEDIA_SQL} SELECT media_id, t.tag, t.value FROM m JOIN (VALUES (2, 271, 'TestMake'), (2, 272, 'TestModel'), (2, 34853, '8'), (4, 305, 'ComfyUI 1.0')) AS t(v, tag, value) ON m.v = t.v WHERE c < 3 AND NOT (c = 1 AND m.v = 4)")
def exif_tags(spark, sf_dir):
    return walk(X.media(spark, sf_dir)).select(_id(), F.explode("exif").alias("tag", "value"))


@query(f"WITH {_VERDICT_SQL} SELECT media_id, folder FROM o WHERE v = 6")
def watermark_declared(spark, sf_dir):
    audited = _audited(spark, sf_dir)
    return audited.where(findings.declares_synthid(F.col("findings"))).select("media_id", "folder")


@query(rf"""WITH {_MEDIA_SQL}, r AS (
  SELECT media_id, unnest(regexp_extract_all(note, '[A-Za-z0-9 ._:/@{{}}"''\[\],-]{{4,}}')) AS r, generate_subscripts(regexp_extract_all(note, '[A-Za-z0-9 ._:/@{{}}"''\[\],-]{{4,}}'), 1) AS k FROM m
), t AS (SELECT media_id, r, k, row_number() OVER (PARTITION BY media_id ORDER BY length(r) DESC, k) AS n FROM r)
SELECT m.media_id, coalesce(string_agg(t.r, ' ' ORDER BY t.n) FILTER (t.n <= 2), '') AS runs FROM m LEFT JOIN t ON m.media_id = t.media_id GROUP BY 1""")
def readable_runs(spark, sf_dir):
    return X.media(spark, sf_dir).select("media_id", S.readable_runs(F.col("note").cast("binary"), 4, 2, " ").alias("runs"))


_CLIPS_SQL = r"""v AS (
  SELECT doc_id AS clip_id, regexp_replace(coalesce(text, ''), '[^\x20-\x7e]', '?', 'g') AS note, ['mp4', 'webm', 'mov'][doc_id % 3 + 1] AS ext, doc_id % 5 AS k FROM documents
), t AS (
  SELECT clip_id, 'tag' AS kind, 'container tag comment' AS label, note AS detail FROM v WHERE k <> 4
  UNION ALL SELECT clip_id, 'tag', 'stream 0 tag encoder', CASE k WHEN 1 THEN 'Sora export' ELSE 'Lavc libx264' END FROM v WHERE k IN (1, 2)
  UNION ALL SELECT clip_id, 'box', 'udta box', '' FROM v WHERE ext <> 'webm'
)"""


def _clips(spark, sf_dir):
    clips = X.clips(spark, sf_dir)
    probes = clips.select("path", M.probe(F.col("probe_json")).alias("probe"))
    return reports.audit(clips, probes).withColumn("clip_id", F.regexp_extract("path", r"^/clips/(\d+)\.", 1).cast("long"))


@query(f"WITH {_CLIPS_SQL} SELECT clip_id, kind, label, detail FROM t")
def video_findings(spark, sf_dir):
    return _clips(spark, sf_dir).select("clip_id", F.explode("findings").alias("f")).select("clip_id", "f.kind", "f.label", "f.detail")


@query(f"""WITH {_CLIPS_SQL}, n AS (SELECT clip_id, count(*) AS n FROM t WHERE {_NAMED.replace("lower(note)", "lower(detail)")} GROUP BY 1)
SELECT v.clip_id, v.ext, CASE WHEN v.ext = 'webm' THEN 'other' ELSE 'iso' END AS container, CASE WHEN k = 3 THEN 1024 ELSE 1000 END AS width, CASE WHEN k = 3 THEN 1024 ELSE 700 END AS height,
  CASE WHEN n.n IS NULL THEN 'unknown' ELSE 'ai-declared' END AS verdict, CAST(coalesce(n.n, 0) + CASE WHEN k = 3 THEN 1 ELSE 0 END AS BIGINT) AS n_evidence FROM v LEFT JOIN n ON v.clip_id = n.clip_id""")
def video_origin(spark, sf_dir):
    return _clips(spark, sf_dir).select("clip_id", S.extension(F.col("rel_path")).alias("ext"), "container", "width", "height", "verdict", F.size("evidence").cast("long").alias("n_evidence"))


# --- cleaning ----------------------------------------------------------------


@query(f"""WITH {_FOUND_SQL} SELECT m.media_id, CASE m.c WHEN 0 THEN 'lossless (JPEG segments rewritten)' WHEN 1 THEN 'lossless (PNG chunks rewritten)' WHEN 2 THEN 'lossless (WebP chunks rewritten)' ELSE 'in place (ISO boxes blanked)' END AS mode,
  CAST(coalesce(sum(CASE WHEN m.c = 3 OR f.kind IN ('info', 'signature') THEN 0 ELSE nbytes + CASE WHEN m.c = 2 THEN nbytes % 2 ELSE 0 END END), 0) AS BIGINT) AS saved, true AS same_picture, true AS same_size,
  count(f.kind) AS n_before, CASE WHEN m.c = 3 AND m.v IN (1, 3, 4, 5, 6) THEN 0 WHEN m.c = 3 AND m.v = 7 THEN 1 ELSE 0 END AS n_left
FROM m LEFT JOIN f ON m.media_id = f.media_id GROUP BY m.media_id, m.c, m.v""")
def clean_audit(spark, sf_dir):
    done = clean.verify(X.media(spark, sf_dir))
    return done.select(_id(), "mode", (F.col("before") - F.col("after")).alias("saved"), "same_picture", "same_size", "n_before", F.col("n_left").cast("int").alias("n_left"))


# What stays: an empty udta box, and signatures in WebP chunks other than EXIF, XMP and ICCP.
@query(f"WITH {_FOUND_SQL} SELECT f.label, count(*) AS n FROM f JOIN m ON f.media_id = m.media_id WHERE NOT (m.c = 3 AND m.v = 7) AND NOT (m.c = 2 AND m.v IN (1, 3, 6)) GROUP BY 1")
def removed_by_label(spark, sf_dir):
    return clean.removed(X.media(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {_MEDIA_SQL} SELECT media_id, CASE WHEN v IN (3, 4, 5, 6) OR (v = 1 AND note <> '') THEN 1 ELSE 0 END AS boxes, CASE WHEN v = 7 THEN 1 ELSE 0 END AS names FROM m WHERE c = 3")
def blanked_boxes(spark, sf_dir):
    videos = X.media(spark, sf_dir).where("container = 'mp4'")
    return clean.verify(videos).select(_id(), F.col("boxes").cast("int").alias("boxes"), F.col("names").cast("int").alias("names"))


_LEFT_SQL = "list_sort(list_transform(list_filter([" + ", ".join(f"'{x}'" for x in LEFTOVER_SIGNATURES) + "], lambda x: len(list_filter(p.pieces, lambda t: contains(lower(t), x))) > 0), lambda x: 'payload:' || x))"


@query(f"""WITH {_MEDIA_SQL} SELECT m.media_id, CASE WHEN m.c <> 0 THEN 'not-a-jpeg' WHEN m.v = 1 THEN array_to_string(list_concat(['COM'], {_LEFT_SQL}), ',') WHEN m.v = 6 THEN 'COM' WHEN m.v IN (2, 4) THEN 'APP1' WHEN m.v = 3 THEN 'APP11,payload:c2pa,payload:jumb' WHEN m.v = 5 THEN 'APP1,payload:http://ns.adobe.com/xap/' WHEN m.v = 7 THEN 'APP2,APP5' ELSE '' END AS labels
FROM m LEFT JOIN p ON m.media_id = p.media_id""")
def leftover_labels(spark, sf_dir):
    media = X.media(spark, sf_dir)
    return findings.leftovers(walk(media)).select(_id(), F.array_join("labels", ",").alias("labels"))


# --- the same over files, which are listed, opened by path and read by ranges -----


@query(SQL["findings_flat"])
def whole_findings(spark, sf_dir):
    files = _published(spark, sf_dir)
    return findings.exploded(findings.with_findings(walk_files(files))).join(files.select("path", "media_id"), "path").select("media_id", "kind", "label", "nbytes")


@query(SQL["findings_by_label"])
def whole_findings_by_label(spark, sf_dir):
    return reports.findings_by_label(findings.exploded(findings.with_findings(walk_files(_published(spark, sf_dir)))))


def _audited_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    audited = reports.audit_files(_published(spark, sf_dir))
    audited = audited.withColumn("folder", S.folder(F.col("rel_path"))).withColumn("kind", S.media_kind(F.col("rel_path")))
    return audited.withColumn("media_id", F.regexp_extract("path", r"/(\d+)~[^/]*$", 1).cast("long"))


@query(SQL["origin_verdicts"])
def whole_verdicts(spark, sf_dir):
    return _audited_files(spark, sf_dir).select("media_id", "verdict", "synthid")


@query(SQL["verdict_rollup"])
def whole_verdict_rollup(spark, sf_dir):
    return reports.verdict_rollup(_audited_files(spark, sf_dir))


@query(SQL["png_texts"])
def whole_png_texts(spark, sf_dir):
    walked = walk_files(_published(spark, sf_dir), keep=("media_id",)).where("container = 'png'")
    return walked.select("media_id", F.explode("text_kv").alias("key", "value"))


@query(SQL["readable_runs"])
def whole_readable_runs(spark, sf_dir):
    """Of the notes as files of their own."""
    root = fresh_folder(spark, "notes")
    publish(X.media(spark, sf_dir).select("path", _numbered_path().alias("out_path"), F.col("note").cast("binary").alias("content")), root)
    notes = M.with_contents(_listed(spark, root))
    return notes.select("media_id", S.readable_runs(F.col("content"), 4, 2, " ").alias("runs"))


@query(SQL["clean_audit"])
def whole_clean_audit(spark, sf_dir):
    """Files cleaned by patch lists and written by the sink; both sides are then inspected by path."""
    before = _published(spark, sf_dir)
    after = _cleaned(spark, before)
    side = lambda files: (
        findings.with_findings(walk_files(files, keep=("media_id",)))
        .join(clean.hash_files(files).select("path", "picture"), "path")
        .select("media_id", "findings", F.struct("width", "height").alias("wh"), "picture", "length")
    )
    old, new = side(before).alias("old"), side(after).alias("new")
    modes = clean.plan_files(before).join(before.select("path", "media_id"), "path").select("media_id", "mode")
    both = old.join(new, "media_id").join(modes, "media_id")
    left = F.filter("new.findings", lambda f: f.kind != "signature")
    return both.select("media_id", "mode", (F.col("old.length") - F.col("new.length")).alias("saved"), (F.col("old.picture") == F.col("new.picture")).alias("same_picture"), (F.col("old.wh").eqNullSafe(F.col("new.wh"))).alias("same_size"), F.size("old.findings").cast("long").alias("n_before"), F.size(left).alias("n_left"))


def _cleaned(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The cleaned copies of listed files, in a folder of their own."""
    root = fresh_folder(spark, "cleaned")
    plans = clean.plan_files(files).join(files.select("path", _numbered_path().alias("out_path")), "path")
    publish(plans.where("pieces IS NOT NULL").select("path", "out_path", "pieces", "error"), root)
    return _listed(spark, root)


_PICTURES = {0: b"\x00\x08\x01\x01\0\0\x3f\0" + X.SCAN + b"\xff\xd9", 1: X.SCAN, 2: X.SCAN[:33], 3: X.SCAN}
_PICTURE_SQL = "CASE c " + " ".join(f"WHEN {c} THEN '{hashlib.sha256(p).hexdigest()}'" for c, p in _PICTURES.items()) + " END"


@query(f"WITH {_MEDIA_SQL} SELECT media_id, {_REL} AS rel_path, {_PICTURE_SQL} AS picture FROM m")
def cleaned_files(spark, sf_dir):
    done = _cleaned(spark, _published(spark, sf_dir))
    return clean.hash_files(done).join(done.select("path", "media_id", "rel_path"), "path").select("media_id", "rel_path", "picture")


def _named_files(spark: SparkSession, sf_dir: str) -> str:
    """Files with the whole texts as contents, under names of many kinds."""
    i = F.col("doc_id")
    s = i.cast("string")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = F.array(F.concat(F.lit("_DSC"), s, F.lit(".JPG")), F.concat(F.lit("."), s, F.lit(".png")), F.concat(F.lit(".hid/a b%20"), s, F.lit(".WebP")), F.concat(F.lit("notes/"), s, F.lit(".txt")), F.concat(F.lit("_deep/er/\u00e9 "), s, F.lit(".mov")), F.concat(F.lit("noext/"), s))
    root = fresh_folder(spark, "named")
    publish(docs.select(s.alias("path"), F.element_at(names, (i % 6 + 1).cast("int")).alias("out_path"), F.coalesce("text", F.lit("")).cast("binary").alias("content")), root)
    return root


_NAMES_SQL = "d AS (SELECT doc_id % 6 AS k, ['_DSC' || doc_id || '.JPG', '.' || doc_id || '.png', '.hid/a b%20' || doc_id || '.WebP', 'notes/' || doc_id || '.txt', '_deep/er/\u00e9 ' || doc_id || '.mov', 'noext/' || doc_id][doc_id % 6 + 1] AS rel_path, strlen(coalesce(text, '')) AS length FROM documents)"


@query(f"WITH {_NAMES_SQL} SELECT rel_path, ['jpg', '', 'webp', 'txt', 'mov', ''][k + 1] AS ext, ['image', NULL, 'image', NULL, 'video', NULL][k + 1] AS kind, length FROM d WHERE k <> 1")
def listed_files(spark, sf_dir):
    return list_all(spark, _named_files(spark, sf_dir), fan_out=3).where("error IS NULL").select("rel_path", "ext", "kind", "length")


@query(f"WITH {_NAMES_SQL} SELECT rel_path FROM d WHERE k IN (3, 5)")
def unsupported_files(spark, sf_dir):
    return list_unsupported(spark, _named_files(spark, sf_dir))


@query(SQL["evidence_flat"])
def whole_evidence(spark, sf_dir):
    return _audited_files(spark, sf_dir).select("media_id", F.explode("evidence").alias("e")).select("media_id", "e.weight", "e.label")


@query(SQL["removed_by_label"])
def whole_removed_by_label(spark, sf_dir):
    before = _published(spark, sf_dir)
    return clean.removed_between(before, _cleaned(spark, before), "media_id").groupBy("label").agg(F.count("*").alias("n"))


# --- names -------------------------------------------------------------------


@query(rf"""WITH {_MEDIA_SQL}, r AS (
  SELECT media_id, folder, regexp_matches(stem, '(?i)(^|[^0-9])916([^0-9]|$)|9x16|\breel\b|reels|\bstory\b|stories') AS tall, regexp_matches(stem, '(?i)(^|[^0-9])45([^0-9]|$)|4x5|\bpost\b|posts|\bfeed\b') AS near FROM m)
SELECT media_id, CASE WHEN tall AND NOT near THEN '916' WHEN near AND NOT tall THEN '45' WHEN tall THEN '45,916' WHEN folder LIKE 'reels%' OR folder LIKE 'stories%' THEN '916' WHEN folder LIKE 'posts%' THEN '45' ELSE '45,916' END AS formats,
  CASE WHEN tall AND near THEN 'both' WHEN tall OR near THEN 'name' WHEN folder IN ('reels', 'stories/day1', 'posts') THEN 'folder' ELSE 'default' END AS why FROM r""")
def routed_formats(spark, sf_dir):
    formats, reason = S.route(F.col("rel_path"))
    why = F.when(reason == "filename matched both tokens", "both").when(F.startswith(reason, F.lit("filename")), "name").when(reason == "input subfolder", "folder").otherwise("default")
    return X.media(spark, sf_dir).select("media_id", F.array_join(formats, ",").alias("formats"), why.alias("why"))


@query(f"WITH {_MEDIA_SQL} SELECT media_id, 'out' AS flat, concat_ws('/', 'out', nullif(folder, ''), stem) AS mirror, 'out/' || stem AS grid, concat('out/', {_REL}) AS cleaned, 'p' || (media_id % 9) || '_45.png' AS name FROM m")
def output_names(spark, sf_dir):
    rel, root = F.col("rel_path"), F.lit("out")
    folders = [naming.out_folder(rel, root, layout).alias(layout) for layout in naming.LAYOUTS]
    name = naming.out_name("p", F.col("media_id") % 9, F.lit("45"), F.lit(True), ".png")
    return X.media(spark, sf_dir).select("media_id", *folders, naming.clean_path(rel, root, "mirror").alias("cleaned"), name.alias("name"))


@query(f"WITH {_MEDIA_SQL} SELECT media_id, row_number() OVER (ORDER BY {_REL}, media_id) AS number FROM m")
def running_numbers(spark, sf_dir):
    """Images and videos share the numbers."""
    return naming.numbered(X.media(spark, sf_dir).select("rel_path", "media_id"), "rel_path", "media_id").select("media_id", "number")


@query(SQL["running_numbers"])
def whole_numbers(spark, sf_dir):
    return naming.numbered(_published(spark, sf_dir).select("rel_path", "media_id"), "rel_path", "media_id").select("media_id", "number")


@query(f"WITH {_MEDIA_SQL}, r AS (SELECT DISTINCT {_REL} AS rel_path, 'out/' || stem AS out_dir FROM m) SELECT rel_path, out_dir, lag(rel_path) OVER (PARTITION BY out_dir ORDER BY rel_path) AS previous FROM r")
def folder_collisions(spark, sf_dir):
    rows = X.media(spark, sf_dir).select("rel_path", naming.out_folder(F.col("rel_path"), F.lit("out"), "grid").alias("out_dir")).distinct()
    return naming.collisions(rows)


_UPLOADS_SQL = """u AS (SELECT page_id AS ord, page_id % 7 AS batch, CASE (page_id // 7) % 9 WHEN 0 THEN 'shot.jpg' WHEN 1 THEN 'SHOT.jpg' WHEN 2 THEN 'shot_1.jpg' WHEN 3 THEN 'notes.txt' WHEN 4 THEN '' WHEN 5 THEN 'clip' || (page_id % 5) || '.mp4' WHEN 6 THEN 'dir/photo.png' ELSE 'img' || page_id || '.webp' END AS name FROM pages)"""


# One upload of each batch at a time: the first of its names that none before it has.
@query(f"""WITH RECURSIVE {_UPLOADS_SQL}, n AS (
  SELECT batch, ord, name, row_number() OVER (PARTITION BY batch ORDER BY ord) AS i, CASE WHEN name = '' THEN 'upload' ELSE regexp_extract(name, '[^/]*$') END AS base FROM u
), h AS (SELECT *, CASE WHEN regexp_matches(base, '^.+\\.[^.]*$') THEN regexp_replace(base, '\\.[^.]*$', '') ELSE base END AS head FROM n),
r(batch, i, ord, name, made, used) AS (
  SELECT batch, i, ord, name, base, [lower(base)] FROM h WHERE i = 1
  UNION ALL
  SELECT batch, i, ord, name, made, list_append(used, lower(made)) FROM (
    SELECT h.batch, h.i, h.ord, h.name, r.used, CASE WHEN NOT list_contains(r.used, lower(base)) THEN base ELSE
      [c FOR c IN [head || '_' || k || substring(base, length(head) + 1) FOR k IN range(1, len(r.used) + 1)] IF NOT list_contains(r.used, lower(c))][1] END AS made
    FROM r JOIN h ON h.batch = r.batch AND h.i = r.i + 1)
) SELECT batch, ord, name, made AS "unique" FROM r""")
def unique_upload_names(spark, sf_dir):
    return naming.unique_names(X.uploads(spark, sf_dir))


@query(f"WITH {_UPLOADS_SQL} SELECT batch, ord, name, CASE WHEN name = 'notes.txt' THEN 'unsupported file type' END AS error FROM u WHERE name <> ''")
def accepted_uploads(spark, sf_dir):
    named = X.uploads(spark, sf_dir).where(S.base_name(F.col("name")) != "")
    return named.select("batch", "ord", "name", F.when(S.media_kind(F.col("name")).isNull(), "unsupported file type").alias("error"))


@query("SELECT page_id AS ord, page_id % 5 IN (0, 2, 3) AS escapes FROM pages")
def path_escapes(spark, sf_dir):
    return X.uploads(spark, sf_dir).select("ord", S.escapes(F.col("rel")).alias("escapes"))


@query("""WITH n AS (SELECT o_orderkey AS k, CAST(o_orderkey AS BIGINT) * o_orderkey * (1 + o_orderkey % 1000) AS n FROM orders)
SELECT k, CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1024**2 THEN CASE WHEN n / 1024 < 10 THEN printf('%.1f KB', n / 1024) ELSE printf('%.0f KB', n / 1024) END
 WHEN n < 1024**3 THEN CASE WHEN n / 1024**2 < 10 THEN printf('%.1f MB', n / 1024**2) ELSE printf('%.0f MB', n / 1024**2) END
 ELSE CASE WHEN n / 1024**3 < 10 THEN printf('%.1f GB', n / 1024**3) ELSE printf('%.0f GB', n / 1024**3) END END AS size_text FROM n""")
def human_sizes(spark, sf_dir):
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("k"), S.human_size(k * k * (1 + k % 1000)).alias("size_text"))


@query("""WITH e AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'bad ' || doc_id || ' Traceback (most recent' WHEN 2 THEN '  ' ELSE 'Traceback x' END AS msg FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE WHEN length(trim(msg)) > 280 THEN substring(trim(msg), 1, 277) || '…' WHEN trim(msg) = '' THEN 'ValueError' ELSE trim(msg) END WHEN 1 THEN 'bad ' || doc_id WHEN 2 THEN 'ValueError' ELSE 'Processing failed.' END AS shown FROM e""")
def short_errors(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    i = F.col("doc_id")
    message = F.when(i % 4 == 0, F.col("text")).when(i % 4 == 1, F.concat(F.lit("bad "), i.cast("string"), F.lit(" Traceback (most recent"))).when(i % 4 == 2, "  ").otherwise("Traceback x")
    return docs.select("doc_id", S.short_error(message, F.lit("ValueError")).alias("shown"))


@query(f"WITH {_MEDIA_SQL} SELECT {_REL} AS rel_path, CASE WHEN media_id < 1024 THEN printf('%d B', media_id) WHEN media_id / 1024 < 10 THEN printf('%.1f KB', media_id / 1024) ELSE printf('%.0f KB', media_id / 1024) END AS size_text, ext FROM m")
def produced_files(spark, sf_dir):
    files = X.media(spark, sf_dir).select("rel_path", F.col("media_id").alias("length"))
    return reports.listing(files).select("rel_path", "size_text", "ext")


# --- grids -------------------------------------------------------------------

_LINES_SQL = """ax AS (SELECT p_partkey AS image_id, p_size AS s, a.axis, p_size + 48 + 5 * a.axis AS n FROM part CROSS JOIN (VALUES (0), (1)) AS a(axis)),
l AS (
  SELECT image_id, axis, n, s, pos, (pos < s % 4 OR pos >= n - s % 4 OR (pos >= n // 2 - 6 + s % 13 AND pos < n // 2 - 6 + s % 13 + s % 7)) AS white
  FROM (SELECT *, unnest(range(0, n)) AS pos FROM ax)
), g AS (SELECT *, white AND s % 11 <> 0 AS hit FROM l),
i AS (SELECT image_id, axis, n, pos, pos - row_number() OVER (PARTITION BY image_id, axis ORDER BY pos) AS island FROM g WHERE hit),
r AS (SELECT image_id, axis, n, min(pos) AS a, max(pos) + 1 AS b FROM i GROUP BY image_id, axis, n, island),
e AS (
  SELECT ax.image_id, ax.axis, ax.n, coalesce(max(r.b) FILTER (r.a = 0), 0) AS x0, coalesce(min(r.a) FILTER (r.b = ax.n), ax.n) AS x1
  FROM ax LEFT JOIN r ON ax.image_id = r.image_id AND ax.axis = r.axis GROUP BY 1, 2, 3
), c AS (SELECT image_id, axis, n, CASE WHEN x1 <= x0 THEN 0 ELSE x0 END AS c0, CASE WHEN x1 <= x0 THEN n ELSE x1 END AS c1 FROM e),
d AS (
  SELECT c.image_id, c.axis, c.n, c.c0, c.c1, min(row(abs((r.a + r.b) / 2.0 - c.n / 2.0), r.a, r.b)) FILTER (r.a IS NOT NULL) AS best
  FROM c LEFT JOIN r ON c.image_id = r.image_id AND c.axis = r.axis AND r.b - r.a >= 4 AND r.a > c.c0 AND r.b < c.c1 AND abs((r.a + r.b) / 2.0 - c.n / 2.0) <= 0.2 * c.n
  GROUP BY 1, 2, 3, 4, 5
), ax2 AS (
  SELECT image_id, axis, n AS length, CAST(coalesce(best[2], round_even(n / 2.0, 0)) AS INTEGER) AS lo_end, CAST(coalesce(best[3], round_even(n / 2.0, 0)) AS INTEGER) AS hi_start,
    c0 AS content_start, c1 AS content_end, best IS NOT NULL AS detected FROM d
)"""


def _axes(spark, sf_dir):
    return grid.detect_axes(X.line_stats(spark, sf_dir))


@query(f"WITH {_LINES_SQL} SELECT image_id, axis, length, lo_end, hi_start, content_start, content_end, detected FROM ax2")
def grid_axes(spark, sf_dir):
    return _axes(spark, sf_dir).drop("runs")


@query(f"WITH {_LINES_SQL.replace('white AND s % 11 <> 0 AS hit', 'white AS hit')} SELECT CAST(image_id AS VARCHAR) AS image_id, axis, length, lo_end, hi_start, content_start, content_end, detected FROM ax2")
def picture_axes(spark, sf_dir):
    return grid.detect_axes(grid.as_lines(grid.line_profile(X.pictures(spark, sf_dir)))).drop("runs")


@query(f"WITH {_LINES_SQL} SELECT image_id, axis, a AS start, b AS \"end\" FROM r")
def white_runs(spark, sf_dir):
    return grid.line_runs(X.line_stats(spark, sf_dir))


@query(f"""WITH {_LINES_SQL}, p AS (
  SELECT y.image_id, k.n AS panel_no, CASE WHEN k.n IN (1, 3) THEN x.content_start ELSE x.hi_start END AS "left", CASE WHEN k.n < 3 THEN y.content_start ELSE y.hi_start END AS upper,
    CASE WHEN k.n IN (1, 3) THEN x.lo_end ELSE x.content_end END AS "right", CASE WHEN k.n < 3 THEN y.lo_end ELSE y.content_end END AS lower, NOT y.detected AS row_fallback, NOT x.detected AS col_fallback
  FROM ax2 AS y JOIN ax2 AS x ON y.image_id = x.image_id AND y.axis = 0 AND x.axis = 1 CROSS JOIN (VALUES (1), (2), (3), (4)) AS k(n))
SELECT * FROM p WHERE "right" - "left" >= 16 AND lower - upper >= 16""")
def grid_panels(spark, sf_dir):
    return grid.large_enough(grid.panels(_axes(spark, sf_dir))).drop("panel_name")


_JOB_SQL = f"""WITH {_LINES_SQL.replace('white AND s % 11 <> 0 AS hit', 'white AS hit')}, f AS (
  SELECT p_partkey AS image_id, p_size AS s, p_size + 48 AS h, p_size + 53 AS w, 'grid_' || p_partkey || '.png' AS rel_path FROM part
), b AS (
  SELECT y.image_id, k.n AS panel_no, CASE WHEN k.n IN (1, 3) THEN x.content_start ELSE x.hi_start END AS x0, CASE WHEN k.n < 3 THEN y.content_start ELSE y.hi_start END AS y0,
    CASE WHEN k.n IN (1, 3) THEN x.lo_end ELSE x.content_end END AS x1, CASE WHEN k.n < 3 THEN y.lo_end ELSE y.content_end END AS y1, NOT y.detected AS row_fallback, NOT x.detected AS col_fallback
  FROM ax2 AS y JOIN ax2 AS x ON y.image_id = x.image_id AND y.axis = 0 AND x.axis = 1 CROSS JOIN (VALUES (1), (2), (3), (4)) AS k(n)
), kept AS (
  SELECT b.*, f.s, f.h, f.w, f.rel_path, row_number() OVER (ORDER BY f.rel_path, b.panel_no) AS number FROM b JOIN f ON b.image_id = f.image_id WHERE x1 - x0 >= 16 AND y1 - y0 >= 16
), xs AS (
  SELECT *, (x < s % 4 OR x >= w - s % 4 OR (x >= w // 2 - 6 + s % 13 AND x < w // 2 - 6 + s % 13 + s % 7)) AS white FROM (SELECT *, unnest(range(x0, x1)) AS x FROM kept)
), ys AS (
  SELECT *, (y < s % 4 OR y >= h - s % 4 OR (y >= h // 2 - 6 + s % 13 AND y < h // 2 - 6 + s % 13 + s % 7)) AS white, (13 * y + image_id) % 200 AS g FROM (SELECT *, unnest(range(y0, y1)) AS y FROM kept)
), cw AS (SELECT number, avg(white::INTEGER) AS part FROM xs GROUP BY 1),
rw AS (SELECT number, avg(CASE WHEN white THEN 255 ELSE g END) AS mean, stddev_pop(CASE WHEN white THEN 255 ELSE g END) AS std FROM ys GROUP BY 1),
tx AS (
  SELECT xs.number, min(x - x0) FILTER (NOT (white OR (mean >= 243 AND std <= 9))) AS a, min(x1 - 1 - x) FILTER (NOT (white OR (mean >= 243 AND std <= 9))) AS b FROM xs JOIN rw ON xs.number = rw.number GROUP BY 1
), ty AS (
  SELECT ys.number, min(y - y0) FILTER (NOT (white OR (g + part * (255 - g) >= 243 AND (255 - g) * sqrt(part * (1 - part)) <= 9))) AS a,
    min(y1 - 1 - y) FILTER (NOT (white OR (g + part * (255 - g) >= 243 AND (255 - g) * sqrt(part * (1 - part)) <= 9))) AS b FROM ys JOIN cw ON ys.number = cw.number GROUP BY 1
), tr AS (
  SELECT kept.*, least((y1 - y0) // 4, coalesce(ty.a, y1 - y0)) AS top, least((y1 - y0) // 4, coalesce(ty.b, y1 - y0)) AS bottom, least((x1 - x0) // 4, coalesce(tx.a, x1 - x0)) AS lft, least((x1 - x0) // 4, coalesce(tx.b, x1 - x0)) AS rgt
  FROM kept JOIN tx ON kept.number = tx.number JOIN ty ON kept.number = ty.number
), t(fmt, tw, th) AS (VALUES ('45', 1080, 1350), ('916', 1080, 1920)),
k AS (
  SELECT *, x0 + lft AS px, y0 + top AS py, x1 - x0 - lft - rgt AS pw, y1 - y0 - top - bottom AS ph, tw::DOUBLE / th AS want, pw::DOUBLE / ph AS have,
    greatest(1, round_even(ph * want, 0))::INTEGER AS nw, greatest(1, round_even(pw / want, 0))::INTEGER AS nh, image_id IN (45, 916) AS single
  FROM tr CROSS JOIN t WHERE NOT (image_id = 45 AND fmt = '916') AND NOT (image_id = 916 AND fmt = '45')
), crop AS (
  SELECT *, CASE WHEN abs(have - want) >= 1e-6 AND have > want THEN (pw - nw) // 2 ELSE 0 END + px AS cx, CASE WHEN abs(have - want) >= 1e-6 AND have <= want THEN (ph - nh) // 2 ELSE 0 END + py AS cy,
    CASE WHEN abs(have - want) >= 1e-6 AND have > want THEN nw ELSE pw END AS ww, CASE WHEN abs(have - want) >= 1e-6 AND have <= want THEN nh ELSE ph END AS hh FROM k
), px AS (
  SELECT number, fmt, string_agg(CASE WHEN y < s % 4 OR y >= h - s % 4 OR (y >= h // 2 - 6 + s % 13 AND y < h // 2 - 6 + s % 13 + s % 7) THEN repeat('ffffff', ww)
    ELSE substring(concat(repeat('ffffff', s % 4), repeat(lpad(hex((13 * y + image_id) % 200), 2, '0'), 3 * (w // 2 - 6 + s % 13 - s % 4)), repeat('ffffff', s % 7), repeat(lpad(hex((13 * y + image_id) % 200), 2, '0'), 3 * (w - w // 2 + 6 - s % 13 - s % 7 - s % 4)), repeat('ffffff', s % 4)), CAST(6 * cx + 1 AS BIGINT), CAST(6 * ww AS BIGINT)) END, '' ORDER BY y) AS hexed
  FROM (SELECT *, unnest(range(cy, cy + hh)) AS y FROM crop) GROUP BY 1, 2
)"""


@query(f"""{_JOB_SQL} SELECT c.rel_path, c.panel_no, c.number, c.fmt, c.row_fallback, c.col_fallback, c.top AS trim_top, c.bottom AS trim_bottom, c.lft AS trim_left, c.rgt AS trim_right, c.cx AS x, c.cy AS y, c.ww AS w, c.hh AS h,
  'panel' || c.number || CASE WHEN single THEN '' ELSE '_' || c.fmt END || '.png' AS out_path, sha256(unhex(px.hexed)) AS pixels_sha256 FROM crop AS c JOIN px ON c.number = px.number AND c.fmt = px.fmt""")
def grid_job(spark, sf_dir):
    """From pixels to numbered panels, trimmed, cut and written; crops keep their size here."""
    pictures = X.pictures(spark, sf_dir).withColumn("rel_path", F.concat(F.lit("grid_"), "path", F.lit(".png")))
    done = grids.split_grids(pictures, fresh_folder(spark, "panels"), full_size=False)
    names = ("rel_path", "panel_no", "number", "fmt", "row_fallback", "col_fallback", "trim_top", "trim_bottom", "trim_left", "trim_right", "x", "y", "w", "h", "out_path", "pixels_sha256")
    return done.where("written > 0 AND error IS NULL").select(*names)


@query(f"""WITH {_LINES_SQL}, w AS (SELECT image_id, axis, n, pos, white AND (s % 11 <> 0 OR 7.0 <= 9.0) AS white FROM l),
t AS (SELECT image_id, axis, n, min(pos) FILTER (NOT white) AS a, max(pos) FILTER (NOT white) AS b FROM w GROUP BY 1, 2, 3)
SELECT image_id, axis, least(CAST(floor(n * 0.25) AS INTEGER), coalesce(a, n)) AS low, least(CAST(floor(n * 0.25) AS INTEGER), coalesce(n - 1 - b, n)) AS high FROM t""")
def panel_trims(spark, sf_dir):
    return grid.trims(X.line_stats(spark, sf_dir))


_CROP_SQL = """b AS (SELECT p_partkey AS panel_id, CAST(p_partkey * 37 % 900 + 10 AS INTEGER) AS w, CAST(p_partkey * 53 % 1100 + 10 AS INTEGER) AS h FROM part),
t(fmt, tw, th) AS (VALUES ('45', 1080, 1350), ('916', 1080, 1920)),
k AS (SELECT *, tw::DOUBLE / th AS want, w::DOUBLE / h AS have, greatest(1, round_even(h * (tw::DOUBLE / th), 0))::INTEGER AS nw, greatest(1, round_even(w / (tw::DOUBLE / th), 0))::INTEGER AS nh FROM b CROSS JOIN t),
c AS (SELECT panel_id, fmt, tw, th, CASE WHEN abs(have - want) < 1e-6 THEN 'none' WHEN have > want THEN 'left/right' ELSE 'top/bottom' END AS axis,
  CASE WHEN abs(have - want) >= 1e-6 AND have > want THEN (w - nw) // 2 ELSE 0 END AS x, CASE WHEN abs(have - want) >= 1e-6 AND have <= want THEN (h - nh) // 2 ELSE 0 END AS y,
  CASE WHEN abs(have - want) >= 1e-6 AND have > want THEN nw ELSE w END AS w, CASE WHEN abs(have - want) >= 1e-6 AND have <= want THEN nh ELSE h END AS h FROM k)"""


@query(f"WITH {_CROP_SQL} SELECT panel_id, fmt, x, y, w, h, axis, CASE WHEN greatest(tw::DOUBLE / w, th::DOUBLE / h) <= 1 THEN 'downsample' ELSE 'upsample + sharpen' END AS method, round(greatest(tw::DOUBLE / w, th::DOUBLE / h), 6) AS factor FROM c")
def centre_crops(spark, sf_dir):
    each = grid.targets(X.panels(spark, sf_dir))
    cut = each.select("panel_id", "fmt", "tw", "th", grid.centre_crop(F.col("w"), F.col("h"), F.col("tw"), F.col("th")).alias("c")).select("panel_id", "fmt", "tw", "th", "c.*")
    factor, method = grid.scale_plan(F.col("w"), F.col("h"), F.col("tw"), F.col("th"))
    return cut.select("panel_id", "fmt", "x", "y", "w", "h", "axis", method.alias("method"), F.round(factor, 6).alias("factor"))


# --- video geometry ----------------------------------------------------------

_VIDEO_SQL = """v0 AS (SELECT o_orderkey AS k, concat_ws(':', o_orderkey % 500, o_orderkey * 3 % 400, o_orderkey % 90 + 10, o_orderkey % 70 + 10) AS box FROM orders),
v AS (SELECT k AS video_id, [1920, 1080, 1280, 721, 1080, 640][k % 6 + 1] AS src_w, [1080, 1920, 720, 1281, 1350, 481][k % 6 + 1] AS src_h,
  CASE WHEN k % 17 = 0 THEN 'bad:' || k WHEN k % 23 = 0 THEN replace(box, ':', ',') WHEN k % 29 = 0 THEN concat_ws(':', k % 500, 5, 0, 9) ELSE box END AS box_text, ['none', 'pad', 'crop'][k % 3 + 1] AS fit FROM v0)"""
_EVEN = "CAST(round_even({0}, 0) - (round_even({0}, 0) % 2) AS BIGINT)"
_BOX_SQL = _VIDEO_SQL + """, x AS (SELECT *, video_id % 17 = 0 AS short, video_id % 17 <> 0 AND video_id % 23 <> 0 AND video_id % 29 = 0 AS empty,
  video_id % 500 AS bx, video_id * 3 % 400 AS by_, video_id % 90 + 10 AS bw, video_id % 70 + 10 AS bh FROM v)"""


def _boxed(spark, sf_dir):
    box, error = S.parse_box(F.col("box_text"))
    return X.video_specs(spark, sf_dir).withColumn("box", box).withColumn("error", error)


@query(f"WITH {_BOX_SQL} SELECT video_id, CASE WHEN short OR empty THEN NULL ELSE concat_ws(':', bx, by_, bw, bh) END AS box, CASE WHEN short THEN 'expected x:y:w:h' WHEN empty THEN 'width and height must be positive' END AS error FROM x")
def parsed_boxes(spark, sf_dir):
    return _boxed(spark, sf_dir).select("video_id", F.when(F.col("box").isNotNull(), S.box_text(F.col("box"))).alias("box"), "error")


@query(f"WITH {_VIDEO_SQL} SELECT video_id, src_w, src_h, 'h264' AS codec, 'aac' AS audio_codec, round(CASE WHEN video_id % 19 = 0 THEN 0 WHEN video_id % 5 = 0 THEN 30000 / 1001 ELSE 25 END::DOUBLE, 6) AS fps, CASE WHEN video_id % 13 = 0 THEN 0 ELSE video_id % 60 END::DOUBLE AS duration FROM v")
def stream_facts(spark, sf_dir):
    facts = X.video_specs(spark, sf_dir).select("video_id", M.probe(F.col("probe_json")).alias("p")).select("video_id", *M.stream_facts(F.col("p")))
    return facts.withColumn("fps", F.round("fps", 6))


@query("""SELECT o_orderkey AS video_id, t.benign, t.label, CASE WHEN t.label = 'container tag title' THEN 'clip ' || o_orderkey ELSE t.detail END AS detail FROM orders
CROSS JOIN (VALUES (false, 'container tag title', ''), (true, 'container tag major_brand', 'isom'), (true, 'stream 1 tag handler_name', 'v'), (false, 'stream 1 tag encoder', 'x')) AS t(benign, label, detail)""")
def container_tags(spark, sf_dir):
    probed = X.video_specs(spark, sf_dir).select(F.col("video_id").alias("path"), M.probe(F.col("probe_json")).alias("probe"))
    return findings.tag_findings(probed).select(F.col("path").alias("video_id"), "benign", "label", "detail")


_E = _EVEN.format
_PLANS_SQL = f"""WITH {_VIDEO_SQL}, t(key, label, tw, th) AS (VALUES ('45', '4:5', 1080, 1350), ('916', '9:16', 1080, 1920)),
n AS (SELECT video_id, 'native' AS label, '' AS key, {_E('src_w * least(1080 / src_w, 1920 / src_h)')} AS out_w, {_E('src_h * least(1080 / src_w, 1920 / src_h)')} AS out_h, src_w, src_h FROM v WHERE fit = 'none'),
e AS (SELECT *, {_E('src_w * least(tw / src_w, th / src_h)')} AS iw, {_E('src_h * least(tw / src_w, th / src_h)')} AS ih, src_w / src_h - tw / th AS off,
  CASE WHEN src_w / src_h > tw / th THEN {_E('src_h * (tw / th)')} ELSE {_E('src_w')} END AS cw, CASE WHEN src_w / src_h > tw / th THEN {_E('src_h')} ELSE {_E('src_w / (tw / th)')} END AS ch FROM v CROSS JOIN t WHERE fit <> 'none')
SELECT video_id, label, key, out_w, out_h, CASE WHEN out_w <> src_w OR out_h <> src_h THEN printf('scale=%d:%d:flags=lanczos', out_w, out_h) ELSE '' END AS chain FROM n
UNION ALL SELECT video_id, label, key, tw, th, CASE WHEN fit = 'pad' THEN printf('scale=%d:%d:flags=lanczos|pad=%d:%d:%d:%d:black', iw, ih, tw, th, (tw - iw) // 2, (th - ih) // 2)
  ELSE (CASE WHEN abs(off) < 1e-6 THEN '' ELSE printf('crop=%d:%d:%d:%d|', cw, ch, (src_w - cw) // 2, (src_h - ch) // 2) END) || printf('scale=%d:%d:flags=lanczos', tw, th) END FROM e"""


@query(_PLANS_SQL)
def output_plans(spark, sf_dir):
    no_crop = F.lit(None).cast("struct<x:int,y:int,w:int,h:int>")
    plans = video.plan_outputs(X.video_specs(spark, sf_dir).withColumn("first_crop", no_crop))
    return plans.select("video_id", "label", "key", "out_w", "out_h", F.array_join("chain", "|").alias("chain"))


@query(f"""WITH {_BOX_SQL}, y AS (SELECT video_id, fit, bw AS src_w, bh AS src_h FROM x WHERE NOT short AND NOT empty)
SELECT p.video_id, label, key, out_w, out_h, concat_ws('|', printf('crop=%d:%d:%d:%d', bw, bh, bx, by_), nullif(chain, '')) AS chain FROM ({_PLANS_SQL.replace("FROM v ", "FROM y ")}) AS p JOIN x ON p.video_id = x.video_id""")
def plans_after_crop(spark, sf_dir):
    """All fits, for the videos with a box: it is cut first, and plans start from its size."""
    plans = video.plan_outputs(_boxed(spark, sf_dir).where("box IS NOT NULL").withColumn("first_crop", F.col("box")))
    return plans.select("video_id", "label", "key", "out_w", "out_h", F.array_join("chain", "|").alias("chain"))


@query(f"WITH {_BOX_SQL} SELECT video_id, CASE WHEN NOT short AND NOT empty AND (bx + bw > src_w OR by_ + bh > src_h) THEN 'crop lies outside the frame' END AS error FROM x")
def crop_guards(spark, sf_dir):
    return _boxed(spark, sf_dir).select("video_id", video.crop_error(F.col("box"), F.col("src_w"), F.col("src_h")).alias("error"))


@query(f"WITH {_BOX_SQL} SELECT video_id, NOT (short OR empty) OR video_id % 3 = 0 AS actionable FROM x WHERE NOT (short OR empty) OR video_id % 2 = 0")
def consented_boxes(spark, sf_dir):
    """Boxes that may be acted on: given ones, and detected ones (here: for videos of even numbers) only where that was accepted."""
    boxed = _boxed(spark, sf_dir).where("box IS NOT NULL OR video_id % 2 = 0")
    return boxed.select("video_id", video.actionable(F.col("box").isNotNull(), F.col("video_id") % 3 == 0).alias("actionable"))


@query(f"""WITH {_BOX_SQL}, t(fmt, uw, uh) AS (VALUES ('45', 4, 5), ('916', 9, 16)),
s AS (SELECT video_id, fmt, src_w, src_h, bx, by_, o.n AS o, uw, uh, CASE o.n WHEN 2 THEN bx WHEN 3 THEN src_w - (bx + bw) ELSE src_w END AS wm, CASE o.n WHEN 0 THEN by_ WHEN 1 THEN src_h - (by_ + bh) ELSE src_h END AS hm
  FROM x CROSS JOIN t CROSS JOIN (VALUES (0), (1), (2), (3)) AS o(n) WHERE NOT short AND NOT empty),
k AS (SELECT *, least(wm // uw, hm // uh) - least(wm // uw, hm // uh) % 2 AS k FROM s WHERE wm >= 32 AND hm >= 32),
q AS (SELECT *, k * uw AS w, k * uh AS h, row_number() OVER (PARTITION BY video_id, fmt ORDER BY k DESC, o) AS rn FROM k WHERE k > 0 AND k * uw >= 32 AND k * uh >= 32)
SELECT x.video_id, t.fmt, round_even(100.0 * q.w / x.src_w, 1)::DOUBLE AS keep_width, CASE WHEN q.o < 2 THEN greatest(0, (x.src_w - w) // 2) WHEN q.bx >= w THEN 0 ELSE x.src_w - w END AS x, CASE WHEN q.o < 2 THEN (CASE WHEN q.by_ >= h THEN 0 ELSE x.src_h - h END) ELSE greatest(0, (x.src_h - h) // 2) END AS y, q.w, q.h
FROM x CROSS JOIN t LEFT JOIN q ON x.video_id = q.video_id AND t.fmt = q.fmt AND q.rn = 1 WHERE NOT short AND NOT empty""")
def crop_suggestions(spark, sf_dir):
    return video.suggest_crops(_boxed(spark, sf_dir).where("box IS NOT NULL")).select("video_id", "fmt", "keep_width", "x", "y", "w", "h")


# --- frames ------------------------------------------------------------------

_PIXELS_SQL = """fv AS (SELECT s_suppkey AS video_id, s_suppkey % 6 AS c FROM supplier),
fp AS (SELECT video_id, c, t, y, x, CASE WHEN c <> 4 AND x BETWEEN (CASE WHEN c IN (1, 3) THEN 114 ELSE 4 END) AND (CASE WHEN c IN (1, 3) THEN 114 ELSE 4 END) + (CASE WHEN c = 5 THEN 29 ELSE 7 END)
    AND y BETWEEN (CASE WHEN c IN (2, 3) THEN 82 ELSE 4 END) AND (CASE WHEN c IN (2, 3) THEN 82 ELSE 4 END) + 7 THEN 230.0::DOUBLE ELSE ((x * 7 + y * 13 + t * (video_id % 5 + 11)) % 160)::DOUBLE END AS gray
  FROM (SELECT *, unnest(range(0, 128)) AS x FROM (SELECT *, unnest(range(0, 96)) AS y FROM (SELECT *, unnest(range(0, 24)) AS t FROM fv)))),
fs AS (SELECT video_id, y, x, avg(gray) AS mean, stddev_pop(gray) AS std FROM fp GROUP BY 1, 2, 3)"""
_OVERLAY_SQL = f"""{_PIXELS_SQL}, mv AS (SELECT video_id, quantile_cont(std, 0.5) AS moving FROM fs GROUP BY 1),
ci AS (SELECT fs.*, mv.moving, CASE WHEN y < 21 AND x < 38 THEN 0 WHEN y < 21 AND x >= 90 THEN 1 WHEN y >= 75 AND x < 38 THEN 2 WHEN y >= 75 AND x >= 90 THEN 3 END AS k FROM fs JOIN mv ON fs.video_id = mv.video_id WHERE mv.moving >= 1.5),
cut AS (SELECT video_id, k, greatest(90, quantile_cont(mean, 0.9)) AS cut FROM ci WHERE k IS NOT NULL GROUP BY 1, 2),
bl AS (SELECT ci.video_id, ci.k, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS bw, max(y) - min(y) + 1 AS bh, count(*) AS mass FROM ci JOIN cut ON ci.video_id = cut.video_id AND ci.k = cut.k WHERE std < greatest(1, 0.6 * moving) AND mean > cut GROUP BY 1, 2),
ok AS (SELECT *, greatest(6, bw // 4) AS pw, greatest(6, bh // 4) AS ph FROM bl WHERE mass >= 40 AND bw >= 8 AND bh >= 8 AND bw <= 128 * 0.22 AND bh <= 96 * 0.14 AND greatest(bw, bh) / least(bw, bh) <= 2.5 AND mass / (bw * bh) >= 0.1),
oc AS (SELECT video_id, k, ['top-left', 'top-right', 'bottom-left', 'bottom-right'][k + 1] AS corner, greatest(0, x0 - pw) AS x, greatest(0, y0 - ph) AS y, least(128, x0 + bw + pw) - greatest(0, x0 - pw) AS w, least(96, y0 + bh + ph) - greatest(0, y0 - ph) AS h, mass FROM ok)"""


def _overlays(spark, sf_dir):
    return frames.overlay_marks(X.frame_clips(spark, sf_dir))


@query(f"WITH {_OVERLAY_SQL} SELECT video_id, corner, x, y, w, h, mass, row_number() OVER (PARTITION BY video_id ORDER BY mass DESC, k) AS rank FROM oc")
def overlay_candidates(spark, sf_dir):
    return _overlays(spark, sf_dir)


@query(f"""WITH {_OVERLAY_SQL}, b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY mass DESC, k) AS rn FROM oc) WHERE rn = 1),
gb AS (SELECT fp.*, fp.gray - lag(fp.gray) OVER (PARTITION BY fp.video_id, t, fp.y ORDER BY fp.x) AS gx, fp.gray - lag(fp.gray) OVER (PARTITION BY fp.video_id, t, fp.x ORDER BY fp.y) AS gy
  FROM fp JOIN b1 ON fp.video_id = b1.video_id WHERE fp.x >= greatest(0, b1.x - 10) AND fp.y >= greatest(0, b1.y - 10) AND fp.x < b1.x + b1.w + 10 AND fp.y < b1.y + b1.h + 10)
SELECT video_id, round((avg(abs(gx)) + avg(abs(gy))) / 2, 6) AS detail, CASE WHEN (avg(abs(gx)) + avg(abs(gy))) / 2 < 6 THEN 'clean' WHEN (avg(abs(gx)) + avg(abs(gy))) / 2 < 15 THEN 'soft' ELSE 'too busy' END AS band FROM gb GROUP BY 1""")
def repair_bands(spark, sf_dir):
    best = _overlays(spark, sf_dir).where("rank = 1")
    detail = frames.box_detail(X.frame_clips(spark, sf_dir), best)
    return detail.select("video_id", F.round("detail", 6).alias("detail"), frames.quality_band(F.col("detail")).alias("band"))


@query()
def frame_recovery(spark, sf_dir):
    return frames.recovery(frames.match_frames(*_marked(spark, sf_dir))).select("video_id", "frames", "recovered", "good", F.round("median_confidence", 3).alias("median_confidence"), "warn")


def _marked(spark, sf_dir):
    clips = X.pan_frames(spark, sf_dir)
    return clips, clips.select("video_id").distinct().select("video_id", *(F.lit(v).alias(c) for c, v in zip("xywh", X.MARK)))


# What moves is known: 3 to 5 pixels a frame to the left, so every frame has one that shows what its mark hides.
@query("SELECT s_suppkey AS video_id, t::INTEGER AS t, true AS matched, -(3 + s_suppkey % 3)::INTEGER AS dx_a_frame, 0 AS dy FROM supplier, range(0, 12) AS r(t)")
def matched_shifts(spark, sf_dir):
    found = frames.match_frames(*_marked(spark, sf_dir))
    return found.select("video_id", "t", "matched", F.round(F.col("dx") / (F.col("source") - F.col("t"))).cast("int").alias("dx_a_frame"), F.round("dy").cast("int").alias("dy"))


@query("SELECT s_suppkey AS video_id, t::INTEGER AS t, true AS matched, true AS same_outside, false AS mark_left FROM supplier, range(0, 12) AS r(t)")
def rebuilt_frames(spark, sf_dir):
    """Frames with their hidden parts put back: nothing else changes, and no row of the mark is left.

    What lies outside the mark is compared by its digest, so frames stay where they are made.
    """
    clips, boxes = _marked(spark, sf_dir)
    x, y, w, h = X.MARK
    between = ", ".join(f"substring(gray, {r} * width + {x + w + 1}, width - {w})" for r in range(y, y + h - 1))
    outside = f"sha2(concat(substring(gray, 1, {y} * width + {x}), {between}, substring(gray, {y + h - 1} * width + {x + w + 1}, length(gray))), 256)"
    mark_left = f"exists(sequence({y}, {y + h - 1}), r -> substring(gray, r * width + {x + 1}, {w}) = X'{bytes([250] * w).hex()}')"
    made = frames.rebuilt_frames(clips, boxes).selectExpr("video_id", "t", "matched", f"{outside} AS made", f"{mark_left} AS mark_left")
    return clips.selectExpr("video_id", "t", f"{outside} AS was").join(made, ["video_id", "t"]).selectExpr("video_id", "t", "matched", "was = made AS same_outside", "mark_left")


@query("""WITH f AS (SELECT user_id AS video_id, event_id, epoch(ts) - epoch(min(ts) OVER (PARTITION BY user_id)) AS ts, epoch(max(ts) OVER (PARTITION BY user_id)) - epoch(min(ts) OVER (PARTITION BY user_id)) AS duration FROM events),
s AS (SELECT *, floor(ts * CASE WHEN duration > 0 THEN greatest(0.5, 24 / duration) ELSE 2 END) AS step FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, step ORDER BY ts) AS n FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY step) AS sample_no FROM r WHERE n = 1),
c AS (SELECT video_id, sample_no, count(*) OVER (PARTITION BY video_id) AS c FROM k WHERE sample_no <= 24)
SELECT video_id, count(*) AS samples FROM c WHERE c >= 2 GROUP BY 1""")
def sampled_frames(spark, sf_dir):
    from pyspark.sql import Window as W

    by = W.partitionBy("user_id")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("s", X.epoch_seconds("ts"))
    rows = events.select(F.col("user_id").alias("video_id"), (F.col("s") - F.min("s").over(by)).alias("ts"), (F.max("s").over(by) - F.min("s").over(by)).alias("duration"))
    return frames.sample_frames(rows).groupBy("video_id").agg(F.count("*").alias("samples"))


# --- jobs and summaries ------------------------------------------------------

_JOBS_SQL = "j AS (SELECT event_id AS job_id, epoch(ts) AS created, CASE WHEN event_id % 31 <> 0 THEN epoch(ts) + value * 60 END AS mtime, user_id AS run_id, ts, event_type = 'error' AS failed FROM events)"


@query(f"WITH {_JOBS_SQL}, w AS (SELECT median(created) AS now FROM j) SELECT job_id FROM j CROSS JOIN w WHERE mtime IS NULL OR greatest(now - created, now - mtime) > 7200")
def expired_jobs(spark, sf_dir):
    """Jobs are judged at the middle of the times at which they were made."""
    jobs = X.jobs(spark, sf_dir)
    return streams.expired(jobs, streams.middle(jobs, "created")).select("job_id")


@query(f"WITH {_JOBS_SQL}, w AS (SELECT {X.NOW}::DOUBLE AS now) SELECT run_id, count(*) AS done, count(*) FILTER (failed) AS failed, 'file_' || max(row(ts, 'file_' || job_id || '.png'))[2][6:-5] || '.png' AS current FROM j GROUP BY 1")
def run_progress(spark, sf_dir):
    return streams.progress(X.jobs(spark, sf_dir).withColumn("ts", F.col("created")))


@query(f"""WITH {_VERDICT_SQL} SELECT count(*) FILTER (c < 3 AND media_id % 40 <> 0) AS grids, count(*) FILTER (c = 3 AND media_id % 40 <> 0) AS videos, CAST(sum(CASE WHEN c < 3 THEN 4 ELSE 1 END) AS BIGINT) AS outputs,
  count(*) FILTER (media_id % 40 = 0) AS skipped, count(*) FILTER (verdict = 'unknown') AS warnings, count(*) FILTER (media_id % 50 = 0) AS failures, count(*) FILTER (media_id % 7 = 0) AS boxed, count(*) FILTER (v = 6) AS not_removed FROM o""")
def run_summary(spark, sf_dir):
    i = F.col("media_id")
    outcomes = _audited(spark, sf_dir).select(
        "kind",
        F.when(F.col("kind") == "image", 4).otherwise(1).alias("outputs"),
        (F.col("verdict") == "unknown").cast("int").alias("warnings"),
        F.when(i % 50 == 0, "failed").alias("error"),
        (i % 7 == 0).alias("boxed"),
        (F.col("synthid") == "declared").alias("declares_watermark"),
        (i % 40 == 0).alias("skipped"),
    )
    return reports.run_summary(outcomes)
