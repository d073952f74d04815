"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediasieve.llm.language_id import identify

    return identify(_read(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediasieve.llm.decontaminate import find_leaks

    return find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediasieve.llm.lm_score import stupid_backoff

    scored = stupid_backoff(_read(spark, sf_dir, "documents"))
    return scored.selectExpr("doc_id", "n_words", "round(log_score, 4) AS log_score", "round(mean_log_score, 6) AS mean_log_score")


OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, i, ws[i] AS w1, ws[i-1] AS p1, ws[i-2] AS p2
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i
        FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents))
), n AS (SELECT count(*) AS n FROM w),
c1 AS (SELECT w1, count(*) AS c FROM w GROUP BY 1),
c2 AS (SELECT p1, w1, count(*) AS c FROM w WHERE i > 1 GROUP BY 1, 2),
c3 AS (SELECT p2, p1, w1, count(*) AS c FROM w WHERE i > 2 GROUP BY 1, 2, 3),
s AS (
  SELECT w.doc_id, ln(CASE
      WHEN w.i > 2 AND c3.c >= 2 THEN c3.c / b2.c
      WHEN w.i > 1 AND c2.c >= 2 THEN c2.c / b1.c * (CASE WHEN w.i > 2 THEN 0.4::DOUBLE ELSE 1::DOUBLE END)
      ELSE c1.c / n.n * (CASE WHEN w.i > 2 THEN 0.16::DOUBLE WHEN w.i > 1 THEN 0.4::DOUBLE ELSE 1::DOUBLE END) END) AS s
  FROM w CROSS JOIN n JOIN c1 ON w.w1 = c1.w1
  LEFT JOIN c2 ON w.p1 = c2.p1 AND w.w1 = c2.w1
  LEFT JOIN c1 AS b1 ON w.p1 = b1.w1
  LEFT JOIN c3 ON w.p2 = c3.p2 AND w.p1 = c3.p1 AND w.w1 = c3.w1
  LEFT JOIN c2 AS b2 ON w.p2 = b2.p1 AND w.p1 = b2.w1
)
SELECT d.doc_id, count(s.s) AS n_words, round(coalesce(sum(s.s), 0), 4) AS log_score, round(avg(s.s), 6) AS mean_log_score
FROM documents AS d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""

def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediasieve.llm.secrets import find_secrets

    found = find_secrets(_read(spark, sf_dir, "documents"))
    count = "CAST(size(filter(spans, s -> s.kind = '{0}')) AS LONG) AS n_{0}".format
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = map(count, ("assign", "access", "hex"))
    return found.selectExpr("doc_id", *base, f"sha2({joined.format("filter(spans, s -> s.kind <> 'random')")}, 256) AS base_sha256", f"{joined.format('spans')} AS spans", count("random"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediasieve.llm.mixing import mix_sources

    draws = mix_sources(_read(spark, sf_dir, "documents"))
    return draws.selectExpr("source", "epoch", "block", "doc_id", "n_tokens", "start", "round(weight, 9) AS weight", "quota")


OP2_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents
), s AS (
  SELECT source, sum(n_tokens)::BIGINT AS total FROM t GROUP BY 1 HAVING sum(n_tokens) > 0
), g AS (SELECT sum(total)::DOUBLE AS everything FROM s),
p AS (SELECT s.source, s.total, s.total / g.everything AS share FROM s CROSS JOIN g),
e AS (
  SELECT 0 AS k, 0::DOUBLE AS low,
    (SELECT ln(sum(share)) - sum(share * ln(share)) / sum(share) >= 0.92 * ln(count(*)) - 1e-12 FROM p) AS done
  UNION ALL
  SELECT k + 1, CASE WHEN NOT done AND (SELECT ln(sum(pow(share, low + pow(0.5, k + 1)))) - sum(pow(share, low + pow(0.5, k + 1)) * ln(pow(share, low + pow(0.5, k + 1)))) / sum(pow(share, low + pow(0.5, k + 1))) >= 0.92 * ln(count(*)) - 1e-12 FROM p)
    THEN low + pow(0.5, k + 1) ELSE low END, done FROM e WHERE k < 30
), r AS (
  SELECT 0 AS k, 0::DOUBLE AS low, (SELECT max(1 / share) / count(*) > 4 + 1e-12 FROM p) AS exceeds
  UNION ALL
  SELECT k + 1, CASE WHEN (SELECT max(pow(share, low + pow(0.5, k + 1) - 1)) / sum(pow(share, low + pow(0.5, k + 1))) > 4 + 1e-12 FROM p)
    THEN low + pow(0.5, k + 1) ELSE low END, exceeds FROM r WHERE k < 30
), x AS (
  SELECT greatest((SELECT CASE WHEN done THEN 1 ELSE low END FROM e WHERE k = 30),
                  (SELECT CASE WHEN exceeds THEN low + pow(0.5, 30) ELSE 0 END FROM r WHERE k = 30)) AS x
), z AS (
  SELECT source, total, round(pow(share, x.x) / (SELECT sum(pow(share, x.x)) FROM p), 12) AS weight FROM p CROSS JOIN x
), w AS (
  SELECT z.source, z.total, z.weight, floor(z.weight * g.everything)::BIGINT AS quota, ceil(z.total / 1048576)::BIGINT AS n_blocks
  FROM z CROSS JOIN g
), d AS (
  SELECT t.source, t.doc_id, t.n_tokens, w.total, w.weight, w.quota, unnest(range(0, greatest(ceil(w.quota / w.total)::BIGINT, 1))) AS epoch,
    ('0x' || substring(md5('17:' || t.doc_id), 1, 8))::BIGINT % w.n_blocks AS block
  FROM t JOIN w ON t.source = w.source
), o AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch
      ORDER BY md5(concat_ws(':', '17', epoch, source, block)), block, md5(concat_ws(':', '17', epoch, doc_id)), doc_id, n_tokens
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d
)
SELECT source, epoch, block, doc_id, n_tokens, CAST(epoch * total + before AS BIGINT) AS start, round(weight, 9) AS weight, quota
FROM o WHERE epoch * total + before < quota
"""

def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediasieve.llm.ngram_join import jaccard_components

    return jaccard_components(_read(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN [array_to_string(ws[i:i+2], ' ') FOR i IN range(1, len(ws) - 1)]
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::VARCHAR[] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n AS x ON a = x.doc_id JOIN n AS y ON b = y.doc_id WHERE 100 * i >= 90 * (x.n + y.n - i)),
r AS (SELECT doc_id AS v, doc_id AS reached FROM documents UNION SELECT r.v, l.b FROM r JOIN l ON r.reached = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents AS d LEFT JOIN n ON d.doc_id = n.doc_id
JOIN (SELECT v, min(reached) AS component_id FROM r GROUP BY 1) AS c ON d.doc_id = c.v
"""

#: (verdict, host, path) of the fixed rules.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediasieve.llm.substring_dedup import remove_repeats

    return remove_repeats(_read(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13),
e AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS g FROM k),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) < doc_id AS gone FROM e),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM f WHERE gone),
p AS (SELECT doc_id, len(ws) AS n_words, unnest(CASE WHEN len(ws) > 0 THEN range(1, len(ws) + 1) ELSE [NULL] END) AS i, ws FROM w),
m AS (SELECT p.doc_id, p.n_words, p.i, ws[p.i] AS word, c.i IS NOT NULL AS gone FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.i = c.i)
SELECT doc_id, any_value(n_words) AS n_words, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded, written as record files in the shared folder, and read back."""
    from mediasieve.llm import token_records as T
    from mediasieve.llm.scratch import scratch_dir

    where = scratch_dir(spark, "token-records")
    T.write_records(_read(spark, sf_dir, "documents"), where)
    return T.read_records(spark, where).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed URLs are those of the pages whose id is divisible by 50; all pages are judged."""
    from mediasieve.llm.url_filter import judge_urls

    pages = _read(spark, sf_dir, "pages")
    return judge_urls(pages, URL_RULES, pages.where("page_id % 50 = 0").select("url"))


OP9_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]+)', 1), '') AS query
  FROM pages
), k AS (
  SELECT page_id, host, path, CASE WHEN host <> '' THEN concat(regexp_replace(host, '^www\.', ''), regexp_replace(path, '/+$', ''), query) END AS key FROM u
), l AS (SELECT DISTINCT key FROM k WHERE page_id % 50 = 0 AND key IS NOT NULL),
r(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
f AS (
  SELECT k.page_id, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
  FROM k JOIN r ON (k.host = r.h OR ends_with(k.host, '.' || r.h)) AND starts_with(k.path, r.p) GROUP BY 1
)
SELECT k.page_id, k.host, k.path, f.rule, coalesce(f.verdict, CASE WHEN l.key IS NULL THEN 'allow' ELSE 'block' END) AS verdict, l.key IS NOT NULL AS listed
FROM k LEFT JOIN f ON k.page_id = f.page_id LEFT JOIN l ON k.key = l.key
"""

def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored as images in archives in the shared folder, and read back through the data source."""
    from mediasieve.llm import media_columns as M
    from mediasieve.llm.scratch import scratch_dir

    where = scratch_dir(spark, "media-archives")
    M.write_archives(_read(spark, sf_dir, "documents"), where)
    return M.features(M.read_archives(spark, where))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediasieve.llm.collocations import mine_collocations

    return mine_collocations(_read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
o AS (
  SELECT lang, m, unnest([array_to_string(ws[i:i+m-1], ' ') FOR i IN range(1, len(ws) - m + 2)]) AS phrase FROM w, range(1, 4) AS t(m)
), f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM o GROUP BY 1, 2, 3),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT lang, m, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE m >= 2 AND f >= 10),
k AS (
  SELECT c.lang, c.m, c.phrase, c.a, t.k, array_to_string(ws[1:t.k], ' ') AS x, array_to_string(ws[t.k+1:], ' ') AS y FROM c JOIN range(1, 3) AS t(k) ON t.k < c.m
), s AS (
  SELECT k.lang, k.m, k.phrase, k.a, min({'score': (1000000::HUGEINT * k.a * k.a // (x.f::HUGEINT * y.f))::BIGINT, 'k': k.k, 'l': x.f, 'r': y.f}) AS cut
  FROM k JOIN f AS x ON k.lang = x.lang AND k.x = x.phrase AND x.m = k.k JOIN f AS y ON k.lang = y.lang AND k.y = y.phrase AND y.m = k.m - k.k GROUP BY ALL
), h AS (
  SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, a AS f, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE m = 3) GROUP BY 1, 2
), g AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.cut.score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, s.cut.l AS l, s.cut.r AS r, t.n, s.cut.score AS score
  FROM s JOIN t ON s.lang = t.lang LEFT JOIN h ON s.lang = h.lang AND s.phrase = h.phrase WHERE h.longer IS NULL OR 100 * h.longer < 50 * s.a
)
SELECT * FROM g WHERE rank <= 2000
"""


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediasieve.llm.clustering import cluster_vectors

    return cluster_vectors(_read(spark, sf_dir, "embeddings"))


_OP12_ROUND = """a{0} AS MATERIALIZED (SELECT v.rid, v.x, min({{'d': list_sum([(v.x[i] - c{0}.y[i]) * (v.x[i] - c{0}.y[i]) FOR i IN range(1, 65)])::BIGINT, 'c': c{0}.c}}) AS best FROM v, c{0} GROUP BY 1, 2),
s{0} AS (SELECT best.c AS c, i, sum(x[i]) AS s, count(*) AS n FROM a{0}, range(1, 65) AS t(i) GROUP BY 1, 2),
m{0} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS y FROM s{0} GROUP BY 1),
c{1} AS MATERIALIZED (SELECT c{0}.c, coalesce(m{0}.y, c{0}.y) AS y FROM c{0} LEFT JOIN m{0} ON c{0}.c = m{0}.c),
"""
OP12_SQL = (
    """
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS rid, [floor(64 * e::DOUBLE)::BIGINT FOR e IN embedding] AS x FROM embeddings
  WHERE len(embedding) = 64 AND len([e FOR e IN embedding IF e IS NULL OR isnan(e) OR isinf(e)]) = 0
), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS y FROM (SELECT sha256('1:' || vec_id) AS h, x FROM v ORDER BY 1, 2 LIMIT 16)),
"""
    + "".join(_OP12_ROUND.format(k, k + 1) for k in range(4))
    + """z AS (SELECT best.c AS c, sum(best.d)::BIGINT AS d FROM a3 GROUP BY 1)
SELECT v.vec_id, a3.best.c::INTEGER AS cluster, a3.best.d AS distance, z.d AS cluster_inertia, (SELECT sum(d)::BIGINT FROM z) AS inertia, sha256(array_to_string(c3.y, ',')) AS centroid_sha256
FROM a3 JOIN v ON a3.rid = v.rid JOIN c3 ON a3.best.c = c3.c JOIN z ON a3.best.c = z.c
"""
)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediasieve.llm.spot_signatures import fingerprint_documents

    found = fingerprint_documents(_read(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "n_chars", "sha2(edited, 256) AS edited_sha256", "array_join(signatures, ',') AS fingerprint", "array_join(edited_signatures, ',') AS edited_fingerprint", "near_edited", "near_next")


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents
), e AS (
  SELECT *, coalesce(lead(doc_id) OVER w, min(doc_id) OVER ()) AS next_id, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next FROM d WINDOW w AS (ORDER BY doc_id)
), t AS (
  SELECT doc_id, 0 AS kind, n, text, next_id FROM e
  UNION ALL SELECT doc_id, 1, n, substring(text, 1, n - n // 4) || substring(next, 1, n // 4), next_id FROM e
), p AS MATERIALIZED (
  SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    regexp_extract_all(low, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM t
), u AS (SELECT doc_id, kind, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM p),
a AS (SELECT *, w IN ('the', 'of', 'and', 'to', 'is', 'was', 'der', 'die', 'und', 'den', 'das', 'ist', 'la', 'le', 'les', 'et', 'des', 'est', 'el', 'los', 'las', 'que', 'del', 'se') AS anchor FROM u),
r AS (SELECT *, count(*) FILTER (NOT anchor) OVER (PARTITION BY doc_id, kind ORDER BY i) AS r FROM a),
c AS (SELECT doc_id, kind, list(w ORDER BY i) AS cs FROM r WHERE NOT anchor GROUP BY 1, 2),
g AS (
  SELECT DISTINCT r.doc_id, r.kind, substring(md5(concat_ws(' ', r.w, cs[r.r + 1], cs[r.r + 2], cs[r.r + 3])), 1, 12) AS s
  FROM r JOIN c ON r.doc_id = c.doc_id AND r.kind = c.kind WHERE r.anchor AND len(cs) >= r.r + 3
), l AS (SELECT doc_id, kind, list(s ORDER BY s) AS sig FROM g GROUP BY 1, 2),
f AS MATERIALIZED (
  SELECT p.doc_id, p.kind, p.n, p.text, p.next_id, coalesce(l.sig, list_sort(list_distinct(CASE
    WHEN len(ws) > 1 THEN [substring(md5(ws[i] || ' ' || ws[i + 1]), 1, 12) FOR i IN range(1, len(ws))]
    WHEN len(ws) = 1 THEN [substring(md5(ws[1]), 1, 12)] ELSE [substring(md5(low), 1, 12)] END))) AS sig
  FROM p LEFT JOIN l ON p.doc_id = l.doc_id AND p.kind = l.kind
), o AS (
  SELECT x.doc_id, x.n AS n_chars, sha256(y.text) AS edited_sha256, x.sig AS a, y.sig AS b, z.sig AS c, len(list_intersect(a, b)) AS ab, len(list_intersect(a, c)) AS ac
  FROM f AS x JOIN f AS y ON x.doc_id = y.doc_id JOIN f AS z ON x.next_id = z.doc_id WHERE x.kind = 0 AND y.kind = 1 AND z.kind = 0
)
SELECT doc_id, n_chars, edited_sha256, array_to_string(a, ',') AS fingerprint, array_to_string(b, ',') AS edited_fingerprint,
  CASE WHEN a = b THEN 1 WHEN least(len(a), len(b)) < 0.2::DOUBLE * greatest(len(a), len(b)) THEN 0 ELSE ab / (len(a) + len(b) - ab) END::DOUBLE AS near_edited,
  CASE WHEN a = c THEN 1 WHEN least(len(a), len(c)) < 0.2::DOUBLE * greatest(len(a), len(c)) THEN 0 ELSE ac / (len(a) + len(c) - ac) END::DOUBLE AS near_next
FROM o
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_mixing": op2_mixing,
    "op3_language_id": op3_language_id,
    "op4_decontaminate": op4_decontaminate,
    "op5_lm_score": op5_lm_score,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_token_records": op7_token_records,
    "op8_ngram_join": op8_ngram_join,
    "op9_url_filter": op9_url_filter,
    "op10_media_columns": op10_media_columns,
    "op11_collocations": op11_collocations,
    "op12_clusters": op12_clusters,
    "op13_fingerprints": op13_fingerprints,
}

SQL: dict[str, str] = {
    "op2_mixing": OP2_SQL,
    "op5_lm_score": OP5_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op8_ngram_join": OP8_SQL,
    "op9_url_filter": OP9_SQL,
    "op11_collocations": OP11_SQL,
    "op12_clusters": OP12_SQL,
    "op13_fingerprints": OP13_SQL,
}
