import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

from mediasieve.llm import url_filter
from mediasieve.llm.queries import QUERIES, SQL, URL_RULES

URLS = [
    "http://www.EXAMPLE.com/en/x",
    "https://a.example.com/en/1?q#f",
    "https://example.com/EN/",
    "http://net/es/",
    "http://x.net/fr/y",
    "http://xnet/fr/y",
    "http://a.org",
    "http://a.org/",
    "http://www.a.org?x=1",
    "http://a.org?x=1#z",
    "no scheme",
    "",
    None,
    "x://y://z/p",
    "http://com",
    "http://com/",
    "http://É.Example.com/en/",
]


def plain(url):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?", url or "")
    if not m:
        return "", "", None
    host = re.sub("[A-Z]", lambda c: c[0].lower(), m[2])
    key = re.sub(r"^www\.", "", host) + m[3].rstrip("/") + (m[4] if m[4] and len(m[4]) > 1 else "")
    return host, m[3], key if host else None


@pytest.mark.parametrize(("limit", "most"), [(1 << 20, 500), (0, 500), (1 << 20, 2)])
def test_urls(spark, limit, most, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_RULES", most)
    rows = [(k, u) for k, u in enumerate(URLS)] + [(3, URLS[3]), (None, "http://a.org/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("key", F.lit(1)).withColumn("verdict", F.lit(2))
    listed = spark.createDataFrame([("http://a.org",), ("ftp://www.a.org?x=1",), (None,), ("",), ("http://a.org/#q",)], "url string")
    got = sorted((tuple(r) for r in url_filter.judge_urls(pages, URL_RULES, listed, max_broadcast_bytes=limit).collect()), key=repr)
    keys = {plain(r.url)[2] for r in listed.collect()} - {None}
    want = []
    for i, u in rows:
        host, path, key = plain(u)
        fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "block" if key in keys else "allow"))
        want.append((i, host, path, rule, verdict, key in keys))
    assert got == sorted(want, key=repr)


def test_long_urls_and_many_without_a_host(spark):
    rows = [(1, "http://a.org/" + "x" * 500_000), (2, "http://" + "a." * 20_000 + "net/es/")] + [(None, None)] * 3000
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = url_filter.judge_urls(pages, URL_RULES, pages.where("page_id = 1").select("url"), max_broadcast_bytes=0)
    assert sorted((r.page_id, r.rule, r.verdict) for r in got.where("page_id IS NOT NULL").collect()) == [(1, None, "block"), (2, "net/es/", "block")]
    assert got.where("page_id IS NULL AND verdict = 'allow'").count() == 3000


def test_empty_list_and_empty_pages(spark):
    pages = spark.createDataFrame([(1, "http://q.org/")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge_urls(pages, URL_RULES, pages.where("page_id = 0")).collect()] == ["allow"]
    assert url_filter.judge_urls(pages.where("page_id = 0"), URL_RULES, pages).count() == 0


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    bloom, n = url_filter.bloom_filter(keys, 5000)
    own = url_filter._bits(F.col("key"), 4)
    other = spark.range(5000, 25000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    passed = lambda df: df.join(bloom, F.pmod(F.xxhash64("key"), F.lit(n)) == F.col("bloom_block")).where(F.col("bloom_bits").bitwiseAND(own) == own).count()
    assert passed(keys) == 5000 and passed(other) < 0.1 * 20000


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in result.fetchall()), key=repr)
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r) for r in df.select(*sorted(names)).collect()), key=repr) == want


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    from mediasieve.llm import decontaminate, language_id
    from mediasieve.llm.scratch import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in P.STAGES:
        out = written(stage(spark, docs, SF), f"test-{name}")
        before, after = ({r.doc_id: r.text for r in df.collect()} if "text" in df.columns else None for df in (docs, out))
        if name != "token_records":
            assert out.columns == docs.columns
        if name == "language_id":
            assert all(language_id.has_letter(t) for t in after.values()) and len(after) >= 0.99 * len(before)
        elif name == "ngram_join":
            sets = {i: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(len(w) - 4)} for i, t in before.items()}
            alike = lambda a, b: sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
            for i in set(before) - set(after):
                assert any(alike(i, j) for j in before if j != i) or len(sets[i]) == 0
            kept = sorted(after)
            assert not any(alike(a, b) for n, a in enumerate(kept) for b in kept[:n])
        elif name == "decontaminate":
            leaked = {i for i, t in before.items() if any(decontaminate.fold(x) in decontaminate.fold(t) for _, x in bench)}
            assert leaked and leaked <= set(before) - set(after)
        elif name == "mixing":
            assert set(after) == set(before)
        else:
            starts = sorted((r.start, r.n_tokens) for r in out.collect())
            assert len(starts) == docs.count() and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
        docs = out
