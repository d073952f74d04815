"""Cases that once took too much memory or time, and the pipeline's stages on tables with nulls, repeats, long texts and clashing columns."""

import random
import time
import tracemalloc
import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_documents import BASE, PASSAGE, ROWS, WORD, frame

from mediasieve.llm import batches, decontaminate, mixing, ngram_join, secrets

SIZES = {"262144b": 262144, "64m": 64 << 20, "1g": 1 << 30, "4096": 4096, "8 kb": 8192, "-1": -1, "2MiB": 2 << 20}


@pytest.mark.parametrize("text", SIZES)
def test_sizes_of_settings(text):
    assert batches._bytes(text) == SIZES[text]


def test_batches_are_bounded_whatever_the_session_says(spark):
    old = spark.conf.get(batches._LIMIT)
    try:
        for value, want in (("64m", batches.BATCH_BYTES), ("1g", batches.BATCH_BYTES), ("65536b", 65536)):
            spark.conf.set(batches._LIMIT, value)
            batches.bound_batches(spark)
            assert batches._bytes(spark.conf.get(batches._LIMIT)) == want
    finally:
        spark.conf.set(batches._LIMIT, old)


# --- n-gram join -----------------------------------------------------------------


def tokens(grams, percent, seed=0):
    n = len(grams)
    begins = ngram_join._size_classes(100 * n // percent + 1)
    found = []
    for c in range(bisect_right(begins, n) - 1, bisect_right(begins, 100 * n // percent)):
        k = 2 * (begins[c + 1] - 1) * (100 - percent) // (100 + percent)
        found += ngram_join._tokens(grams, c, k, ngram_join._spare_parts(ngram_join._least_overlap(begins[c], percent), k), seed).tolist()
    return found


def test_unlinked_sets_seldom_meet_in_a_part():
    """8000 sets of 30 of the same 3000 n-grams, none linked: 1.4 million pairs met while empty parts had names."""
    rng = np.random.default_rng(0)
    vocabulary = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    met = Counter(t for _ in range(8000) for t in set(tokens(np.unique(vocabulary[rng.choice(3000, 30, replace=False)]), 80)))
    assert sum(n * (n - 1) // 2 for n in met.values()) < 100_000 and max(met.values()) < 50


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_linked_sets_meet_in_a_part(percent):
    rng = np.random.default_rng(percent)
    linked = 0
    for trial in range(3000):
        n = int(rng.integers(1, 90))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        gone = min(n, int(rng.integers(0, n // 4 + 2)))
        b = np.concatenate([a[gone:], rng.integers(0, 2**63, int(rng.integers(0, gone + 3)), dtype=np.uint64)])
        if len(b) and 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
            linked += 1
            assert set(tokens(a, percent, trial % 3)) & set(tokens(b, percent, trial % 3))
    assert linked > 300


# --- decontamination, secrets, mixing ------------------------------------------------


def test_repetitive_short_text_against_many_alike_patterns_is_bounded():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, f"{prose(30)} {'-' * 88} {prose(10)}") for i in range(300)]
    matcher = decontaminate.Matcher(decontaminate.patterns_of(items, 0.1, 96))
    old = decontaminate._MAX_HITS
    tracemalloc.start()
    found = matcher.matches([b"-" * 2000])[0]
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
    decontaminate._MAX_HITS = 1 << 40
    try:
        assert set(matcher.matches([b"-" * 2000])[0]) == set(found)
    finally:
        decontaminate._MAX_HITS = old


def test_one_long_run_of_many_parts_takes_linear_time():
    encoding = secrets.load_encoding(None)
    for run in ("internationalization/" * 50_000, "abcdefghijklmnopqrstuvwxyzABCDEF" * 32_000, "Q7x-" * 250_000):
        began = time.perf_counter()
        secrets.scan(run, encoding, 2.2)
        assert time.perf_counter() - began < 15


def test_rows_without_an_id_are_dealt_over_blocks(spark):
    rows = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    drawn = mixing.mix_sources(rows, block_tokens=100)
    assert drawn.select("block").distinct().count() == 40
    assert mixing.realise(rows, drawn).count() == drawn.count()


# --- the pipeline's stages ---------------------------------------------------------------


@pytest.fixture(scope="module")
def stages():
    P = pytest.importorskip("corpus_pipeline")
    return dict(P.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (1, PASSAGE), (None, "alone")], "item_id long, text string").write.parquet(str(where / "benchmark.parquet"))
    return str(where)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def ids_texts(counter):
    return Counter({(r[0], r[1]): n for r, n in counter.items()})


def near_copies(rows):
    """Ids that go, by 5-word shingles and 80 %."""
    sets = []
    for i, t in rows:
        ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} or ({tuple(ws)} if ws else set()))
    label = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if rows[a][0] is not None and rows[b][0] is not None and sets[a] and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i for (i, _), least in zip(rows, label) if i is not None and least < i}


def test_language_stage_on_odd_rows(spark, stages, docs, sf):
    before, after = rows_of(docs), rows_of(stages["language_id"](spark, docs, sf))
    assert all(after[r] <= before[r] for r in after)
    assert all(after[r] in (0, before[r]) for r in before)  # equal rows share a fate
    assert not any(after[r] for r in before if not any(c.isalpha() for c in r[1] or ""))
    assert sum(after.values()) > 0.8 * sum(n for r, n in before.items() if len(WORD.findall(r[1] or "")) > 20)


def test_near_copies_stage_on_odd_rows(spark, stages, docs, sf):
    before = rows_of(docs)
    gone = near_copies(ROWS)
    assert gone and rows_of(stages["ngram_join"](spark, docs, sf)) == Counter({r: n for r, n in before.items() if r[0] not in gone})


def test_leak_stage_on_odd_rows(spark, stages, docs, sf):
    before = rows_of(docs)
    leaks = {r for r in before if decontaminate.fold(PASSAGE) in decontaminate.fold(r[1])}
    assert len(leaks) == 5 and rows_of(stages["decontaminate"](spark, docs, sf)) == Counter({r: n for r, n in before.items() if r not in leaks})


def test_mixing_stage_on_odd_rows(spark, stages, docs, sf):
    before, after = rows_of(docs), rows_of(stages["mixing"](spark, docs, sf))
    drawn = mixing.mix_sources(docs, max_repeat=2.0, budget_ratio=None)
    times = Counter((r.doc_id, r.source) for r in drawn.collect())
    assert set(after) == set(before) and all(n >= before[r] for r, n in after.items())
    got = Counter()
    for r, n in after.items():
        got[r[0], r[3] or ""] += n
    assert got == times
    assert max(n / before[r] for r, n in after.items()) <= 3


def test_record_stage_on_odd_rows(spark, stages, docs, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    crc = lambda t: zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    found = stages["token_records"](spark, docs, sf).collect()
    assert Counter((r.doc_id, r.ids_crc32) for r in found) == Counter((i, crc(t)) for i, t in ROWS)
    ends = sorted((r.start, r.n_tokens) for r in found)
    assert ends[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))
    ids = [r.doc_id for r in sorted(found, key=lambda r: r.start) if r.doc_id is not None]
    assert ids == sorted(ids)


def test_stages_on_an_empty_table(spark, stages, docs, sf):
    none = docs.where("doc_id = -1")
    for name, stage in stages.items():
        out = stage(spark, none, sf)
        assert out.count() == 0
        assert name == "token_records" or out.columns == docs.columns


def test_a_long_text_passes_all_stages(spark, stages, sf):
    long = " ".join(random.Random(9).choice(BASE.split()) + str(k % 977) for k in range(300_000))
    docs = spark.createDataFrame([(1, long, "en", "a", len(long)), (2, long[:-2] + "zz", "en", "a", len(long)), (3, BASE, "de", "b", len(BASE))], "doc_id long, text string, lang string, source string, n_chars long")
    kept = stages["ngram_join"](spark, docs, sf)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert stages["decontaminate"](spark, docs, sf).count() == 3
    assert stages["token_records"](spark, docs, sf).count() == 3
