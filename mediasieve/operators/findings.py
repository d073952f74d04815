"""Findings: every removable item of a file, from its walked row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasieve.functions.dictionaries import BENIGN_TAGS, SIGNATURES

FINDING = "array<struct<kind:string,label:string,detail:string,nbytes:long>>"


def _finding(kind, label, detail, nbytes) -> Column:
    return F.struct(kind.alias("kind"), label.alias("label"), detail.alias("detail"), nbytes.cast("long").alias("nbytes"))


def _signatures() -> Column:
    found = [
        F.when(n > 0, _finding(F.lit("signature"), F.lit(label), F.format_string(f"%d occurrence(s) of '{s}'", n), F.lit(0)))
        for k, (s, label) in enumerate(SIGNATURES)
        for n in [F.col("signature_counts")[k]]
    ]
    return F.array_compact(F.array(*found)).cast(FINDING)


def with_findings(walked: DataFrame) -> DataFrame:
    """``walked`` with a findings array: records, then what image libraries show, then tags (if it has a column ``probe``), then signatures."""
    records = F.transform(F.filter("records", lambda r: r.label.isNotNull()), lambda r: _finding(r.kind, r.label, r.detail, r.length)).cast(FINDING)
    info = F.transform("info", lambda i: _finding(F.lit("info"), F.concat(F.lit("info: "), i.key), F.lit(""), i.nbytes)).cast(FINDING)
    return walked.withColumn("findings", F.concat(records, info, *([removable_tags(F.col("probe"))] if "probe" in walked.columns else []), _signatures()))


def exploded(found: DataFrame) -> DataFrame:
    """(path, pos, kind, label, detail, nbytes) of every finding."""
    return found.select("path", F.posexplode("findings").alias("pos", "f")).select("path", "pos", "f.*")


def removable_tags(probe: Column) -> Column:
    """Findings of the container and stream tags of a parsed probe text that aren't benign, in its order."""

    def of(tags: Column, where: Column) -> Column:
        entries = F.filter(F.map_entries(F.coalesce(tags, F.create_map().cast("map<string,string>"))), lambda e: ~F.lower(e.key).isin(*BENIGN_TAGS))
        return F.transform(entries, lambda e: _finding(F.lit("tag"), F.concat(where, e.key), F.coalesce(e.value, F.lit("")), F.lit(0))).cast(FINDING)

    streams = F.transform(F.coalesce(probe["streams"], F.array()), lambda s, k: of(s.tags, F.format_string("stream %d tag ", k)))
    return F.concat(of(probe["format"]["tags"], F.lit("container tag ")), F.flatten(streams))


def tag_findings(probed: DataFrame) -> DataFrame:
    """(path, benign, kind, label, detail) of container and stream tags of ``probed(path, probe)``."""
    container = probed.select("path", F.explode("probe.format.tags").alias("tag", "value"), F.lit("container tag ").alias("where"))
    streams = probed.select("path", F.posexplode("probe.streams").alias("k", "s")).select("path", F.explode("s.tags").alias("tag", "value"), F.format_string("stream %d tag ", "k").alias("where"))
    return container.unionByName(streams).select("path", F.lower("tag").isin(*BENIGN_TAGS).alias("benign"), F.lit("tag").alias("kind"), F.concat("where", "tag").alias("label"), F.col("value").alias("detail"))


def declares_synthid(findings: Column) -> Column:
    return F.exists(findings, lambda f: F.contains(F.lower(F.concat(f["label"], f["detail"])), F.lit("synthid")))


def leftovers(walked: DataFrame) -> DataFrame:
    """(path, labels): sorted names of segments and signatures that a JPEG output should not hold; ``not-a-jpeg`` for others."""
    segments = F.transform(F.filter("records", lambda r: r.label.isNotNull()), lambda r: r.rtype)
    payload = F.transform("leftover_signatures", lambda s: F.concat(F.lit("payload:"), s))
    labels = F.when(F.col("container") == "jpeg", F.array_sort(F.array_distinct(F.concat(segments, payload)))).otherwise(F.array(F.lit("not-a-jpeg")))
    return walked.select("path", labels.alias("labels"))
