"""Reports over inspected files: small aggregates of per-file rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasieve.functions.scalars import base_name, extension, folder, human_size, media_kind
from mediasieve.operators.findings import with_findings
from mediasieve.operators.origin import assess
from mediasieve.operators.records import walk, walk_files
from mediasieve.sources.media import hidden, stream_facts


def audit(media: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """``media(path, rel_path, content)`` inspected and judged: one nested row a file, without its bytes.

    A file's extension says whether it is a video; its bytes (``container``) do
    where the extension is of neither kind. ``probes(path, probe)`` (parsed
    probe texts) give videos their tags, as findings, and the size of the first
    video stream. Only walked rows are joined with them, not bytes.
    """
    return judge(walk(media, keep=("rel_path",)), probes)


def audit_files(listed: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """``audit`` of files of any size, which the tasks open by URI: ``listed(path, rel_path)``."""
    return judge(walk_files(listed, keep=("rel_path",)), probes)


def judge(walked: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """``audit`` of walked rows that have a ``rel_path``."""
    kind = media_kind(F.col("rel_path"))
    walked = walked.withColumn("is_video", F.when(kind.isNull(), F.col("container") == "iso").otherwise(kind == "video"))
    if probes is not None:
        one = probes.groupBy("path").agg(F.first("probe", ignorenulls=True).alias("probe"))
        walked = walked.join(one, "path", "left").withColumn("probe", F.when(F.col("is_video"), F.col("probe")))
        facts = {c: stream_facts(F.col("probe"))[k] for k, c in enumerate(("width", "height"))}
        walked = walked.withColumns({c: F.coalesce(fact.cast("int"), F.col(c)) for c, fact in facts.items()})
    return assess(with_findings(walked).drop("probe"))


def as_json(audited: DataFrame) -> DataFrame:
    """(path, report): findings, evidence and verdict of each file as one JSON text, for export."""
    fields = ("container", "width", "height", "findings", "evidence", "verdict", "headline", "explanation", "synthid", "synthid_note", "error")
    return audited.select("path", F.to_json(F.struct(*fields)).alias("report"))


def verdict_rollup(audited: DataFrame) -> DataFrame:
    """Files by folder, kind and verdict with subtotals; ``level`` tells them apart (grouping id)."""
    rolled = audited.rollup("folder", "kind", "verdict").agg(F.count("*").alias("files"), F.grouping_id().alias("level"))
    return rolled.select("folder", "kind", "verdict", "files", F.col("level").cast("long").alias("level"))


def findings_by_label(exploded: DataFrame) -> DataFrame:
    """Files, occurrences and bytes of each kind and label of findings."""
    return exploded.groupBy("kind", "label").agg(F.countDistinct("path").alias("files"), F.count("*").alias("occurrences"), F.sum("nbytes").alias("nbytes"))


def overview(audited: DataFrame) -> DataFrame:
    """Files by kind, and those with a finding."""
    return audited.groupBy("kind").agg(F.count("*").alias("files"), F.count_if(F.size("findings") > 0).alias("with_findings"))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """One row over ``outcomes(kind, outputs, warnings, error, boxed, declares_watermark, skipped)``."""
    return outcomes.agg(
        F.count_if((F.col("kind") == "image") & ~F.col("skipped")).alias("grids"),
        F.count_if((F.col("kind") == "video") & ~F.col("skipped")).alias("videos"),
        F.coalesce(F.sum("outputs"), F.lit(0)).alias("outputs"),
        F.count_if("skipped").alias("skipped"),
        F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"),
        F.count_if(F.col("error").isNotNull()).alias("failures"),
        F.count_if("boxed").alias("boxed"),
        F.count_if("declares_watermark").alias("not_removed"),
    )


def listing(files: DataFrame) -> DataFrame:
    """Produced files (rel_path, length) by name, with size text and extension; previews are left out."""
    return files.where(~hidden(F.col("rel_path"))).select("rel_path", base_name(F.col("rel_path")).alias("name"), folder(F.col("rel_path")).alias("folder"), human_size(F.col("length")).alias("size_text"), extension(F.col("rel_path")).alias("ext")).orderBy("rel_path")
