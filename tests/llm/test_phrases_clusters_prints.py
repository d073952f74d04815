"""Collocations, centroid clusters and spot signatures against plain Python on small tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediasieve.llm import clustering, collocations, spot_signatures

# --- collocations --------------------------------------------------------------


def brute_phrases(rows, max_words=3, min_count=10, percent=50, top=2000):
    counts, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            ws = re.findall("[^ \t]+", piece)
            total[lang] += len(ws)
            for m in range(1, max_words + 1):
                for i in range(len(ws) - m + 1):
                    key = lang, tuple(ws[i : i + m])
                    counts[key] = counts.get(key, 0) + 1
    found = []
    for (lang, p), a in counts.items():
        if len(p) < 2 or a < min_count:
            continue
        inside = [b for (other, q), b in counts.items() if other == lang and len(q) > len(p) and b >= min_count and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= percent * a for b in inside):
            continue
        score, k = min((1000000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
        found.append((lang, " ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], total[lang], score))
    out = []
    for lang in {f[0] for f in found}:
        ranked = sorted((f for f in found if f[0] == lang), key=lambda f: (-f[6], -f[2], f[1].encode()))[:top]
        out += [(lang, n, *f[1:]) for n, f in enumerate(ranked, 1)]
    return sorted(out)


def mined(docs, **how):
    return sorted(tuple(r) for r in collocations.mine_collocations(docs, **how).collect())


def test_collocations_equal_plain_counts(spark):
    rnd = random.Random(3)
    words = ["New", "york", "city", "é", "of", "the", "x.y", "B", "tab\tbed"]
    rows = [(" ".join(rnd.choices(words, k=rnd.randrange(0, 40))) + rnd.choice(["", ".", "!\n", " ,"]), rnd.choice(["en", "fr", None])) for _ in range(60)]
    rows += [(None, "en"), ("", None), ("the the the the the", "de"), ("the the the the the", "de"), ("a" * 5000 + " of the " * 900, "en")]
    docs = spark.createDataFrame([(t, lang, 1, "z") for t, lang in rows], "text string, lang string, f int, phrase string").repartition(5)
    for how in ({"min_count": 3}, {"min_count": 2, "max_words": 2}, {"min_count": 2, "max_words": 4, "percent": 80, "top": 7}):
        assert mined(docs, **how) == brute_phrases(rows, **how)
    assert mined(docs.limit(0)) == []
    assert mined(spark.createDataFrame([(None, None)], "text string, lang string")) == []


def test_long_texts_are_counted_across_their_parts(monkeypatch, spark):
    rnd = random.Random(5)
    text = "".join(rnd.choice(["alpha", "Beta", "g", "."]) + rnd.choice([" ", "  ", "\t", ", "]) for _ in range(3000))
    parts = list(collocations._parts(text.encode(), 40, 3))
    assert len(parts) > 100
    levels = {d: Counter() for d in range(3)}
    for lang, n, names, found in collocations.shard_levels([("en", t, c) for t, c in parts], 3):
        names = names.to_pylist()
        for d, level in enumerate(found):
            for j, f in enumerate(level.endpos.tolist()):
                levels[d][b" ".join(names[c[j] - 1] for c in reversed(level.codes))] += f
    whole = {d: Counter() for d in range(3)}
    for piece in re.split(rb"[.,]", text.lower().encode()):
        ws = piece.split()
        for d in range(3):
            whole[d].update(b" ".join(ws[i : i + d + 1]) for i in range(len(ws) - d))
    assert levels == whole


def test_states_and_links_of_the_automaton():
    rnd = random.Random(1)
    codes = np.array([rnd.randrange(1, 4) for _ in range(200)])
    piece = np.sort(np.array([rnd.randrange(12) for _ in range(200)]))
    levels = collocations.automaton(codes, piece, np.ones(200, bool), 3)
    ends = {}
    for e in range(200):
        for d in range(3):
            if e - d >= 0 and piece[e - d] == piece[e]:
                ends.setdefault(tuple(codes[e - d : e + 1]), set()).add(e)
    found = [{tuple(int(c[j]) for c in reversed(level.codes)): (j, int(level.endpos[j])) for j in range(len(level.endpos))} for level in levels]
    assert {k: len(v) for k, v in ends.items()} == {k: n for level in found for k, (_, n) in level.items()}
    longest = collocations.states(levels)
    for d in (1, 2):
        for k, (j, _) in found[d].items():
            assert found[d - 1][k[1:]][0] == levels[d].link[j]
    for d in range(3):
        for k, (j, _) in found[d].items():
            same = [q for q in ends if len(q) > len(k) and q[-len(k) :] == k and ends[q] == ends[k]]
            assert longest[d][j] == (not same)


# --- clusters --------------------------------------------------------------------


def brute_clusters(rows, k, rounds, dim, scale=64):
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == dim and all(e is not None and math.isfinite(e) for e in x):
            kept.append((vec_id, [math.floor(scale * e) if abs(e) < 2**53 else scale * int(e) for e in x], x))
    order = sorted(kept, key=lambda v: (hashlib.sha256(f"1:{'' if v[0] is None else v[0]}".encode()).hexdigest(), v[2]))
    centroids = [v[1] for v in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, x, _ in kept:
            members[nearest(x)[1]].append(x)
        centroids = [[sum(col) // len(m) for col in zip(*m)] if m else c for m, c in zip(members, centroids)]
    found = [(v, *reversed(nearest(x))) for v, x, _ in kept]
    sums = Counter()
    for _, c, d in found:
        sums[c] += d
    small = lambda n: n if n < 2**63 else None
    out = [(v, c, small(d), small(sums[c]), small(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for v, c, d in found]
    return sorted(out, key=repr)


def clustered(df, **how):
    return sorted((tuple(r) for r in clustering.cluster_vectors(df, **how).collect()), key=repr)


SCHEMA = "vec_id long, embedding array<double>, cluster string"


def test_clusters_equal_plain_integers(spark, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK_ROWS", 16)
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(i % 3 * 2, 1) for _ in range(4)]) for i in range(150)]
    rows += [(7, rows[7][1])] * 20 + [(None, [0.5, 0.25, -1.0, 2.0])] * 3 + [(7, [9.0, 9.0, 9.0, 9.0])]
    rows += [(900, None), (901, [1.0]), (902, [1.0, None, 2.0, 3.0]), (903, [1.0, float("nan"), 2.0, 3.0]), (904, [1.0, float("inf"), 2.0, 3.0]), (905, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(4)
    for k, rounds in ((5, 3), (16, 2), (500, 1)):
        assert clustered(df, k=k, rounds=rounds, dim=4) == brute_clusters(rows, k, rounds, 4)
    assert clustered(df.limit(0), dim=4) == []
    assert clustered(df.where("vec_id >= 900"), dim=4) == []


@pytest.mark.parametrize("size", [1e4, 1e7, 1e9, 1e12, 1e200, 1.7e308])
def test_clusters_of_large_components_are_exact(spark, size):
    rnd = random.Random(4)
    rows = [(i, [rnd.uniform(-size, size) for _ in range(3)]) for i in range(40)]
    assert clustered(spark.createDataFrame([(*r, "") for r in rows], SCHEMA).repartition(3), k=4, rounds=2, dim=3) == brute_clusters(rows, 4, 2, 3)


def test_the_product_in_doubles_is_used_only_while_it_is_exact():
    rnd = np.random.default_rng(0)
    for bits in (8, 20, 22, 24, 26, 29, 31, 40):
        x = rnd.integers(-(2**bits), 2**bits, (50, 64))
        c = rnd.integers(-(2**bits), 2**bits, (5, 64))
        cluster, distance = clustering.nearest(x, c)
        far = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x]
        assert cluster.tolist() == [f.index(min(f)) for f in far]
        assert [int(d) for d in distance] == [min(f) for f in far]


# --- spot signatures -----------------------------------------------------------------


def brute_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    ws = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)
    digest = lambda *parts: hashlib.md5(" ".join(parts).encode()).hexdigest()[:12]
    found = set()
    for i, w in enumerate(ws):
        if w in spot_signatures.ANCHORS:
            chain = [v for v in ws[i + 1 :] if v not in spot_signatures.ANCHORS][:3]
            if len(chain) == 3:
                found.add(digest(w, *chain))
    if not found:
        found = {digest(a, b) for a, b in zip(ws, ws[1:])} if len(ws) > 1 else {digest(ws[0])} if ws else {digest(low)}
    return sorted(found)


def alike(a, b):
    if a == b:
        return 1.0
    if min(len(a), len(b)) < 0.2 * max(len(a), len(b)):
        return 0.0
    return len(set(a) & set(b)) / len(set(a) | set(b))


def brute_prints(rows):
    rows = [(i, t or "") for i, t in rows]
    key = lambda i: (i is not None, i or 0)
    ids = sorted({i for i, _ in rows}, key=key)
    head = {i: min((t for j, t in rows if j == i), key=lambda t: hashlib.md5(t.encode()).digest()) for i in ids}
    out = []
    for i, t in rows:
        after = head[ids[(ids.index(i) + 1) % len(ids)]]
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        a, b, c = map(brute_set, (t, edited, after))
        out.append((i, len(t), edited, a, b, alike(a, b), alike(a, c)))
    return sorted(out, key=repr)


def printed(df):
    return sorted((tuple(r) for r in spot_signatures.fingerprint_documents(df).collect()), key=repr)


def test_fingerprints_equal_plain_python(spark):
    rnd = random.Random(6)
    words = ["the", "of", "The", "and", "house", "tree", "red", "café", "9", "la", "und", "x", "𝄞"]
    rows = [(3 * i, " ".join(rnd.choices(words, k=rnd.randrange(0, 60))) + rnd.choice(["", "!", " the"])) for i in range(50)]
    rows += [(60, None), (61, ""), (62, "..."), (63, "?!"), (64, "the of and"), (65, "the " * 30000), (66, "one"), (67, "the house of red trees and the house of red trees")]
    rows += [(None, "no id the house of red"), (None, "another one"), (None, None)] + [(300, "same text of the same house here")] * 40 + [(300, "other text")] + [(-(2**63), "least"), (2**63 - 1, "the last of the texts is here")]
    df = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, k int, next_signatures string").repartition(5)
    assert printed(df) == brute_prints(rows)
    assert printed(df.limit(0)) == []
    for few in ([(5, "alone of the many words here")], [(None, "x")], [(None, "x y z"), (None, "the a b c")], [(1, "a"), (None, "b c")]):
        assert printed(spark.createDataFrame(few, "doc_id long, text string")) == brute_prints(few)


def test_neighbours_are_found_over_many_ranges(spark):
    ids = [7 * i * i - 1000 for i in range(400)]
    got = {r.k: r.nk for r in spot_signatures.next_ids(spark.createDataFrame([(i, False) for i in ids], "k long, z boolean")).collect()}
    assert got == dict(zip(ids, ids[1:] + ids[:1]))


def test_length_partitions_of_alike_sets_are_neighbours(spark):
    n = spark.range(1, 400).select(F.col("id").alias("a")).crossJoin(spark.range(1, 400).select(F.col("id").alias("b"))).where("a <= b AND a >= 0.2 * b")
    part = spot_signatures.length_partition
    assert n.where(part(F.col("b")) - part(F.col("a")) > 1).count() == 0


def test_fingerprints_run_without_python(spark):
    df = spark.createDataFrame([(1, "the house of red trees"), (2, "and the blue one")], "doc_id long, text string")
    plan = spot_signatures.fingerprint_documents(df.selectExpr("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
