"""Origin: evidence in what a file declares about itself, and a verdict.

Pixels are never judged. Wordings keep two facts: removing a declaration does
not change where a file came from, and a pixel watermark outlives cleaning.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediasieve.functions.dictionaries import CAMERA_TAGS, GENERATION_KEYS, GENERATOR_NAMES, GENERATOR_SIZES, TEXT_TAGS
from mediasieve.operators.findings import declares_synthid

EVIDENCE = "array<struct<weight:string,label:string,detail:string>>"

#: So many names are looked for one by one, and so many bytes of names are sent to each task at most.
MANY_NAMES, MAX_NAME_BYTES = 64, 64 << 20
#: (verdict, headline, explanation)
VERDICTS = (
    ("ai-declared", "The file says that it was generated", "A declaration inside the file, not a guess. Removing it would not change where the file came from."),
    ("ai-likely", "Possibly generated", "Nothing declares an origin; this is circumstantial, and many ordinary files look the same."),
    ("camera-like", "Looks like a camera picture", "Camera settings are recorded. They can be copied from other files, so this is no proof."),
    ("unknown", "No origin markers", "Nothing says where the file came from, as for any file whose metadata has been removed."),
)


def _evidence(weight: str, label: str, detail: Column) -> Column:
    return F.struct(F.lit(weight).alias("weight"), F.lit(label).alias("label"), detail.alias("detail"))


def blobs(is_video: Column) -> Column:
    """array of (place, text) that names are looked for in: findings, and for images text keys and EXIF texts."""
    pair = lambda a, b: F.struct(a.alias("place"), b.alias("text"))
    found = F.transform("findings", lambda f: pair(f.label, f.detail))
    keys = F.transform(F.map_entries("text_kv"), lambda e: pair(F.concat(F.lit("text: "), e.key), e.value))
    tags = F.filter(F.array(*(pair(F.lit(f"EXIF tag {t}"), F.coalesce(F.element_at("exif", F.lit(t)), F.lit(""))) for t in TEXT_TAGS)), lambda b: F.trim(b.text) != "")
    return F.when(is_video, found).otherwise(F.concat(found, keys, tags))


def with_names_found(df: DataFrame, names: Sequence[str], whole_words: bool = False) -> DataFrame:
    """``df`` with ``names_found``: whether each text of its ``blobs``, in lower case, holds one of the names."""
    listed = sorted({n for n in names if n})
    size = sum(len(n.encode()) for n in listed)
    if size > MAX_NAME_BYTES:
        raise ValueError(f"names of {size} bytes; {MAX_NAME_BYTES} are the most that each task is given")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for n in listed:
            automaton.add_word(n, len(n))
        automaton.make_automaton()
        inner = re.compile(r"\w")

        def holds(text: str | None) -> bool:
            for last, n in automaton.iter(text or ""):
                if not whole_words or not (inner.match(text[last - n : last - n + 1]) or inner.match(text[last + 1 : last + 2])):
                    return True
            return False

        for batch in batches:
            texts = batch.column("_low").to_pylist()
            found = pa.array([[holds(t) for t in some or []] for some in texts], pa.list_(pa.bool_()))
            yield batch.set_column(batch.schema.get_field_index("_low"), "names_found", found)

    low = df.withColumn("_low", F.transform("blobs", lambda b: F.lower(b.text)))
    return low.mapInArrow(search, T.StructType([*df.schema.fields, T.StructField("names_found", T.ArrayType(T.BooleanType()))]))


def assess(found: DataFrame, names: tuple[str, ...] = GENERATOR_NAMES, whole_words: bool = False) -> DataFrame:
    """``found`` (walked rows with findings and is_video) with evidence, verdict, synthid, headline and explanation.

    Names match inside words, as the list of names asks; ``whole_words`` asks
    for word borders. A few names are looked for one after another in the plan;
    of more than MANY_NAMES each task builds one automaton, which reads a text
    once, however many they are.
    """
    video = F.coalesce(F.col("is_video"), F.lit(False))
    df = found.withColumn("blobs", blobs(video))
    if len(names) > MANY_NAMES:
        df = with_names_found(df, names, whole_words)
        holds = lambda b, k: F.get("names_found", k)
    else:
        listed = F.array(*map(F.lit, names)).cast("array<string>")
        has = (lambda text, n: F.regexp_like(text, F.concat(F.lit(r"(?<!\w)\Q"), n, F.lit(r"\E(?!\w)")))) if whole_words else F.contains
        holds = lambda b, k: F.exists(listed, lambda n: has(F.lower(b.text), n))
    raw = F.array_compact(
        F.array(
            F.when(F.col("says_generated"), _evidence("declared", "C2PA assertion: trainedAlgorithmicMedia", F.lit("the file states that a generative model made it"))),
            F.when(F.col("says_composite"), _evidence("declared", "C2PA assertion: composite with AI media", F.lit("a part of the file was generated"))),
            F.when(
                F.exists("findings", lambda f: F.contains(F.lower(F.concat_ws(" ", f.label, f.detail)), F.lit("c2pa")) & F.contains(F.lower(F.concat_ws(" ", f.label, f.detail)), F.lit("manifest"))),
                _evidence("declared", "C2PA / Content Credentials manifest", F.lit("a signed provenance record is attached")),
            ),
        )
    )
    named = F.transform(
        F.filter("blobs", holds),
        lambda b: _evidence("declared", "Generator named in metadata", F.concat(b.place, F.lit(" -> "), F.substring(F.trim(b.text), 1, 80))),
    )
    kinds = F.create_map(*(F.lit(x) for kv in GENERATION_KEYS.items() for x in kv))
    keys = F.transform(
        F.filter(F.map_keys("text_kv"), lambda k: F.lower(k).isin(*GENERATION_KEYS)),
        lambda k: _evidence("declared", "Generation record embedded", F.concat(F.element_at(kinds, F.lower(k)), F.lit(" ("), k, F.lit(")"))),
    )
    keys = F.when(video, F.array().cast(EVIDENCE)).otherwise(keys.cast(EVIDENCE))
    camera = F.array_compact(F.array(*(F.when(~F.coalesce(F.element_at("exif", F.lit(t)), F.lit("")).isin("", "0"), F.lit(label)) for t, label in CAMERA_TAGS.items())))
    df = df.withColumn("camera", F.when(video, F.array().cast("array<string>")).otherwise(camera))
    size = F.struct("width", "height").isin(*(F.struct(F.lit(w).alias("width"), F.lit(h).alias("height")) for w, h in GENERATOR_SIZES))
    other = F.array_compact(
        F.array(
            F.when(F.size("camera") >= 3, _evidence("camera", "Camera capture data present", F.array_join(F.slice(F.array_sort("camera"), 1, 6), ", "))),
            F.when(F.coalesce(size, F.lit(False)) & (F.size("camera") == 0), _evidence("circumstantial", "Size typical of a generator", F.format_string("%dx%d, and no camera data", "width", "height"))),
            F.when(~video & (F.size("camera") == 0) & (F.size("findings") == 0), _evidence("circumstantial", "No metadata at all", F.lit("as in a stripped or exported file"))),
        )
    )
    df = df.withColumn("evidence", F.concat(raw.cast(EVIDENCE), named.cast(EVIDENCE), keys, other.cast(EVIDENCE)))
    weight = lambda w: F.size(F.filter("evidence", lambda e: e.weight == w))
    verdict = F.when(weight("declared") > 0, "ai-declared").when(weight("circumstantial") >= 2, "ai-likely").when(weight("camera") > 0, "camera-like").otherwise("unknown")
    in_blobs = F.exists("blobs", lambda b: F.contains(F.lower(F.concat_ws(" ", b.place, b.text)), F.lit("synthid")))
    synthid = F.when(F.col("says_synthid") | in_blobs, "declared").otherwise("not-declared")
    words = lambda k: F.element_at(F.create_map(*(F.lit(x) for v in VERDICTS for x in (v[0], v[k]))), F.col("verdict"))
    note = (
        F.when(F.col("synthid") == "declared", "A pixel watermark is declared; it stays in the picture when all metadata is removed.")
        .when(video | (F.col("verdict") == "ai-declared"), "No pixel watermark is declared, which does not mean that there is none: it would be invisible and outlive all metadata, and only its maker's detector could tell.")
        .otherwise("No pixel watermark is declared; only its maker's detector could tell whether the pixels hold one.")
    )
    return df.withColumn("verdict", verdict).withColumn("synthid", synthid).withColumn("headline", words(1)).withColumn("explanation", words(2)).withColumn("synthid_note", note).drop("blobs", "camera", "names_found")


def still_declared(found: DataFrame) -> DataFrame:
    """Paths of files that declare a pixel watermark: it is not removed by cleaning."""
    return found.where(declares_synthid(F.col("findings"))).select("path")
