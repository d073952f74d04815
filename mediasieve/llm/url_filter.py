"""URL filter: host and path rules, then a list of URLs behind a blocked Bloom filter."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasieve.llm.scratch import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: More rules are joined; fewer are one expression.
MAX_RULES = 500


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without slashes at its end, query if any; no scheme or fragment. Null without a host."""
    query = F.regexp_extract(url, r"^(?s:.*?)://[^?#]*(\?[^#]+)", 1)
    text = F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(path(url), r"/+$", ""), query)
    return F.when(host(url) != "", text)


def rule_columns(url_host: Column, url_path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits, as one expression; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for says, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((url_host == rule_host) | url_host.endswith("." + rule_host)) & url_path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _ruled(parsed: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``parsed`` with the columns rule and rule_verdict, by a join.

    A rule can fit a page only if its host is one of the page's host and the
    domains above it, and its path one of the beginnings of the page's path. So
    each different host and path gives a key for each such domain and each
    length that a rule's path has.
    """
    spark = parsed.sparkSession
    # Of rules for the same host and path the one that is later in order holds, as in ``rule_columns``.
    kept = {(h, p): v for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]))}
    table = spark.createDataFrame([(h, p, v) for (h, p), v in kept.items()], "rule_host string, rule_path string, says string")
    lengths = F.lit(sorted({len(p) for _, p in kept}))
    urls = parsed.select("host", "path").distinct()
    labels, most = F.split("host", r"\."), max(h.count(".") for h, _ in kept) + 1  # no rule's host has more labels
    domains = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    keyed = urls.select("host", "path", F.explode(domains).alias("rule_host"), F.filter(lengths, lambda n: n <= F.length("path")).alias("lengths"))
    keyed = keyed.select("host", "path", "rule_host", F.explode("lengths").alias("n")).withColumn("rule_path", F.col("path").substr(F.lit(1), F.col("n")))
    rule = F.concat("rule_host", "rule_path")
    best = keyed.join(table, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max(F.struct(F.length(rule), rule, "says")).alias("best"))
    best = best.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("best.col2").alias("rule"), F.col("best.says").alias("rule_verdict"))
    return parsed.join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left").drop("_host", "_path")


def _bits(key: Column, n_bits: int) -> Column:
    """A word of 64 bits with one bit set for each of n_bits six-bit pieces of a second hash."""
    h = F.xxhash64(key, F.lit("bits"))
    mask = F.lit(0).cast("long")
    for i in range(n_bits):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return mask


def bloom_filter(keys: DataFrame, n_keys: int, bits_per_key: int = 16, n_bits: int = 4) -> tuple[DataFrame, int]:
    """A blocked Bloom filter of ``keys(key)`` as rows (bloom_block, bloom_bits), and its number of blocks.

    Each key belongs to one 64-bit block; blocks without keys have no row.
    """
    n_blocks = max(1, math.ceil(n_keys * bits_per_key / 64))
    at = F.pmod(F.xxhash64("key"), F.lit(n_blocks))
    return keys.groupBy(at.alias("bloom_block")).agg(F.bit_or(_bits(F.col("key"), n_bits)).alias("bloom_bits")), n_blocks


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    listed: DataFrame,
    bits_per_key: int = 16,
    n_bits: int = 4,
    max_broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) for every row of ``pages(page_id, url)``.

    The longest rule decides; without one a page is blocked if its canonical URL
    is among those of ``listed(url)``. A blocked Bloom filter of the list passes
    possible hits to an exact join, which removes false positives; the rest of
    the pages never enters that join. The filter is broadcast only if its rows
    take ``max_broadcast_bytes`` at most, else it is joined by block.

    Null URLs and such without ``://`` have empty host and path, fit no rule and
    are on no list: allow. Repeated rows stay; null ids stay; an empty list
    blocks nothing; further columns are ignored. Pages are read and parsed once
    and written to the shared folder, without their URLs.
    """
    parsed = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), canonical(F.col("url")).alias("key"))
    if len(rules) > MAX_RULES:
        parsed = _ruled(written(parsed, "urls-parsed"), rules)
    else:
        rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
        parsed = parsed.withColumn("rule", rule).withColumn("rule_verdict", verdict)
    keys = written(listed.select(canonical(F.col("url")).alias("key")).where("key IS NOT NULL").distinct(), "urls-listed")
    n_keys = keys.count()
    bloom, n_blocks = bloom_filter(keys, n_keys, bits_per_key, n_bits)
    if min(n_keys, n_blocks) * 32 <= max_broadcast_bytes:
        bloom = F.broadcast(bloom)
    own = _bits(F.col("key"), n_bits)
    # Pages without a key are dealt over all blocks.
    block = F.pmod(F.when(F.col("key").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("key")), F.lit(n_blocks))
    possible = F.coalesce(F.col("bloom_bits").bitwiseAND(own) == own, F.lit(False))
    tested = parsed.withColumn("bloom_block", block).join(bloom, "bloom_block", "left").withColumn("key", F.when(possible, F.col("key")))
    tested = written(tested.select("page_id", "host", "path", "rule", "rule_verdict", "key"), "urls-tested")
    hits = tested.where("key IS NOT NULL").join(keys.withColumn("hit", F.lit(True)), "key", "left").withColumn("listed", F.coalesce("hit", F.lit(False)))
    columns = ["page_id", "host", "path", "rule", "rule_verdict", "listed"]
    both = tested.where("key IS NULL").withColumn("listed", F.lit(False)).select(*columns).unionAll(hits.select(*columns))
    return both.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
