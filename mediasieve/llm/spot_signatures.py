"""Document fingerprints: chains of content words that follow common words, as sets compared by pruned Jaccard similarity.

DataFrame and SQL functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mediasieve.llm.scratch import written

#: Common words that a chain may follow.
ANCHORS = ("the", "of", "and", "to", "is", "was", "der", "die", "und", "den", "das", "ist", "la", "le", "les", "et", "des", "est", "el", "los", "las", "que", "del", "se")
#: Content words of a chain.
CHAIN = 3
#: Hexadecimal digits of a signature.
DIGITS = 12
#: Pairs whose set lengths keep their likeness below this aren't compared.
LEAST = 0.2
#: Ranges of ids in which neighbours are looked for, at most and at least, and ids of a range.
_RANGES, _FEW, _RANGE_IDS = 1000, 64, 250_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words: ASCII but digits and letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands for the content word after the last one.
_STOP = "¤"


def _digest(text: Column) -> Column:
    return F.substring(F.md5(text), 1, DIGITS)


def with_signatures(df: DataFrame, text: str, out: str, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """``df`` with the sorted set of signatures of a text column that has no nulls.

    Words are runs of ASCII letters and digits and all other characters, A-Z in
    lower case. Each anchor gives a signature with the ``chain`` words after it
    that are no anchors, if there are so many. A text without any has its pairs
    of neighbouring words instead, or its one word, or itself.
    """
    if not all(a.isalnum() and a.isascii() for a in anchors):
        raise ValueError("anchors must be ASCII words")
    unit = f"(?:(?:{'|'.join(anchors)}) )*+[^ ]++"  # the anchors before a content word, and the word
    last = lambda u: F.substring_index(u, " ", -1)
    found = df.withColumn("_plain", F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _BETWEEN, " ")))
    found = found.withColumn("_units", F.regexp_extract_all(F.concat("_plain", F.lit(" " + _STOP)), F.lit(unit), F.lit(0)))
    n = F.greatest(F.size("_units") - chain, F.lit(0))
    found = found.withColumn("_chains", F.arrays_zip(*[F.slice("_units", k + 1, n).alias(f"u{k}") for k in range(chain)]))

    def signatures(c: Column) -> Column:
        names = F.split(c["u0"], " ", -1)
        tail = F.concat_ws(" ", *(last(c[f"u{k}"]) for k in range(chain)))
        return F.transform(F.slice(names, 1, F.size(names) - 1), lambda a: _digest(F.concat(a, F.lit(" "), tail)))

    anchored = F.filter("_chains", lambda c: F.contains(c["u0"], F.lit(" ")))
    found = found.withColumn("_set", F.array_distinct(F.flatten(F.transform(anchored, signatures))))
    words = F.split("_plain", " ", -1)
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: _digest(F.concat(a, F.lit(" "), b)))
    few = F.when(F.contains("_plain", F.lit(" ")), F.array_distinct(pairs)).otherwise(F.array(_digest(F.when(F.col("_plain") == "", F.translate(text, _UPPER, _LOWER)).otherwise(F.col("_plain")))))
    return found.withColumn(out, F.array_sort(F.when(F.size("_set") > 0, F.col("_set")).otherwise(few))).drop("_plain", "_units", "_chains", "_set")


def length_partition(n: Column, least: float = LEAST) -> Column:
    """Number of the partition of sets of n elements. Each is 1 / least times as wide as the one before, so alike sets are in one or in neighbours."""
    return F.floor(F.log(n.cast("double")) / F.lit(-math.log(least)) + F.lit(1e-9)).cast("int")


def likeness(a: Column, b: Column, least: float = LEAST) -> Column:
    """Jaccard similarity of two sorted sets of one element at least; 0 without comparing if their lengths alone keep it below ``least``."""
    x, y = F.size(a), F.size(b)
    apart = (F.abs(length_partition(x, least) - length_partition(y, least)) > 1) | (F.least(x, y) < F.lit(least) * F.greatest(x, y))
    shared = F.size(F.array_intersect(a, b))
    return F.when(a == b, 1.0).when(apart, 0.0).otherwise(shared / (x + y - shared))


def next_ids(ids: DataFrame) -> DataFrame:
    """(k, z, nk, nz): each distinct id (k, or null where z) of ``ids(k, z)`` and the next in order, null first, the first after the last.

    Ids are cut into ranges at approximate quantiles and looked at range by
    range; the driver holds the first id of each of the 1000 ranges at most.
    """
    n = ids.count()
    ranges = min(_RANGES, max(_FEW, math.ceil(n / _RANGE_IDS)))
    real = ids.where("NOT z")
    cuts = real.agg(F.percentile_approx("k", F.array(*(F.lit(j / ranges) for j in range(1, ranges))), F.lit(10_000)).alias("cuts")).first()[0] or []
    cuts = sorted(set(cuts))
    block = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<long>"), lambda c: c <= F.col("k"))) if cuts else F.lit(0)
    dealt = real.withColumn("block", block)
    firsts = dict(dealt.groupBy("block").agg(F.min("k")).collect())
    smallest = min(firsts.values(), default=0)
    has_null = n > 0 and bool(ids.where("z").take(1))
    after, later = [], None
    for j in range(len(cuts), -1, -1):
        after.append(later)
        later = firsts.get(j, later)
    ahead = F.element_at(F.array(*(F.lit(v).cast("long") for v in reversed(after))), F.col("block") + 1)
    following = F.coalesce(F.lead("k").over(W.partitionBy("block").orderBy("k")), ahead)
    wrapped = dealt.select("k", "z", following.alias("nk"))
    found = wrapped.select("k", "z", F.coalesce("nk", F.lit(0 if has_null else smallest)).cast("long").alias("nk"), (F.col("nk").isNull() & F.lit(has_null)).alias("nz"))
    only_null = ids.where("z").select("k", "z", F.lit(smallest).cast("long").alias("nk"), F.lit(not firsts).alias("nz"))
    return found.unionAll(only_null)


def fingerprint_documents(docs: DataFrame, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN, least: float = LEAST) -> DataFrame:
    """For every row of ``docs(doc_id, text)`` its fingerprint, that of its edited text, and likenesses.

    Columns: doc_id, n_chars, edited, signatures, edited_signatures, near_edited,
    near_next. The edited text ends with the first floor(n_chars / 4) characters
    of the next document instead of its own. Likenesses are Jaccard
    similarities; pairs whose set lengths keep them below ``least`` have 0.

    Texts are shuffled once, by id and hash; the prefix and the signatures that
    a document hands to the one before it are shuffled by that one's key. Who
    is next is found from the ids alone.

    Null texts are empty. Rows with a null id come before all others. Of rows
    that share an id the text with the smallest hash is what precedes them gets
    as next document; all of them get the same next document. Equal rows are
    handled once and come out as often as they went in. A table of one document
    has itself as next; an empty table gives no rows. Further columns are
    ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(F.coalesce(doc_id, F.lit(0)).alias("k"), doc_id.isNull().alias("z"), F.unhex(F.md5(text)).alias("h"), text.alias("text"))
    key = ["k", "z", "h"]
    stats = written(rows.select(*key, F.char_length("text").cast("long").alias("n")).distinct(), "spot-rows")
    ids = written(stats.groupBy("k", "z").agg(F.min("h").alias("nh")), "spot-ids")
    heads = ids.select(F.col("k").alias("nk"), F.col("z").alias("nz"), "nh")
    asked = stats.join(next_ids(ids.select("k", "z")), ["k", "z"]).join(heads, ["nk", "nz"])
    asked = written(asked.select(F.struct(*key).alias("of"), F.floor(F.col("n") / 4).cast("int").alias("take"), F.col("nk").alias("k"), F.col("nz").alias("z"), F.col("nh").alias("h")), "spot-asked")

    # Both uses ask for the same columns, so one exchange serves both.
    texts = rows.groupBy(*key).agg(F.first("text").alias("text"), F.count("*").alias("copies")).where("copies > 0")
    given = with_signatures(texts.join(asked, key).select("of", "take", "text"), "text", "next_signatures", anchors, chain)
    given = given.select("of.*", "take", F.substring("text", F.lit(1), F.col("take")).alias("prefix"), "next_signatures")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - F.col("take")), F.col("prefix"))
    whole = texts.join(given, key).withColumn("n_chars", F.char_length("text")).withColumn("edited", edited)
    whole = with_signatures(with_signatures(whole, "text", "signatures", anchors, chain), "edited", "edited_signatures", anchors, chain)
    judged = whole.select(
        F.when(~F.col("z"), F.col("k")).alias("doc_id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited",
        "signatures",
        "edited_signatures",
        likeness(F.col("signatures"), F.col("edited_signatures"), least).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures"), least).alias("near_next"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    )
    return judged.drop("copy")
