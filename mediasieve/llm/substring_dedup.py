"""Removal of word runs that repeat across documents, by compacting the de Bruijn graph of repeated k-mers.

Words are k - 1 to a node and k to an edge; an edge that starts in more than
one document is repeated. Its smallest source coordinate (document, place) is
shared by all of its occurrences, and edges that follow one another in a
document and at the source, without a branch to another source between them,
compact into one path: a span of the document and a span of the source. Rows
may share an id: a coordinate also says which of the id's rows it is in, and
blocks are dealt by that as well.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasieve.llm import blocks, words
from mediasieve.llm.batches import bound_batches, give_back, slices
from mediasieve.llm.scratch import written

ANCHOR = 5
_LISTS = pa.schema([("block", pa.int32()), ("kind", pa.string()), ("part", pa.int32()), ("size", pa.int32()), ("one", pa.binary()), ("two", pa.binary()), ("doc", pa.binary()), ("nth", pa.binary()), ("place", pa.binary())])
_SPANS = pa.schema([("block", pa.int32()), ("row", pa.int32()), ("start", pa.int64()), ("n", pa.int64()), ("src_doc", pa.int64()), ("src_nth", pa.int64()), ("src_start", pa.int64()), ("digest", pa.binary())])
_ASKED = pa.schema([("src_doc", pa.int64()), ("src_nth", pa.int64()), ("src_start", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])
_WINDOWS = pa.schema([("block", pa.int32()), ("row", pa.int32()), ("start", pa.int64()), ("doc", pa.int64()), ("nth", pa.int64()), ("digest", pa.binary())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
_JUDGED = pa.schema([*_RESULT, ("refuted", pa.bool_())])
_SQL = {
    "lists": "block int, kind string, part int, size int, one binary, two binary, doc binary, nth binary, place binary",
    "spans": "block int, row int, start long, n long, src_doc long, src_nth long, src_start long, digest binary",
    "asked": "src_doc long, src_nth long, src_start long, n long, digest binary",
    "windows": "block int, row int, start long, doc long, nth long, digest binary",
    "result": "doc_id long, n_words long, n_removed long, kept_sha256 string",
    "judged": "doc_id long, n_words long, n_removed long, kept_sha256 string, refuted boolean",
}


def _rows(table: pa.Table) -> tuple[list[int], np.ndarray, list[bytes]]:
    """Ids, places among the rows of the id, and texts of a block, by id and text.

    A place's lower 16 bits are the row's salt (by its text), the others its
    rank among the rows of the block with that id and salt.
    """
    found = sorted(zip(table.column("doc_id").to_pylist(), table.column("salt").to_pylist(), blocks.texts_of(table)))
    first: dict[tuple[int, int], int] = {}
    nth = np.array([k - first.setdefault((i, s), k) << 16 | s for k, (i, s, _) in enumerate(found)], np.int64)
    return [i for i, _, _ in found], nth, [t for _, _, t in found]


def _digest(some: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(some), digest_size=16).digest()


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


class _Windows:
    """The windows of k words of a block, in the order of (doc_id, text, place)."""

    def __init__(self, table: pa.Table, k: int, bits: int):
        give_back()
        self.ids, self.nth, self.texts = _rows(table)
        self.k = k
        self.hashes, self.counts = words.word_hashes(self.texts)
        within = words.runs_within(self.counts, k)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)[: len(within)]
        self.at = np.flatnonzero(within)
        # The anchor of a window is the smallest hash of its runs of ANCHOR words: equal windows have equal anchors.
        grams = words.gram_hashes(self.hashes, ANCHOR)
        size = len(within)
        anchor = grams[:size].copy()
        for j in range(1, k - ANCHOR + 1):
            np.minimum(anchor, grams[j : j + size], out=anchor)
        anchor, row = anchor[self.at] >> np.uint64(64 - bits), self.row[self.at]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        self.run = np.cumsum(new) - 1
        self.keys, first, self.place = np.unique(anchor[new], return_index=True, return_inverse=True)
        rows = row[new]
        self.several = np.bincount(self.place, rows != rows[first][self.place], len(self.keys)) > 0

    def choose(self, bits_back: list[dict], hash_bits: int) -> None:
        """Keeps the windows whose anchor is in more than one document; ``at``, and their hashes of ``hash_bits`` and half as many more sorted with first places."""
        parts = [np.unpackbits(np.frombuffer(r["one"], np.uint8), count=r["size"]).astype(bool) for r in sorted(bits_back, key=lambda r: r["part"])]
        keep = self.several | np.concatenate([np.empty(0, bool), *parts])
        self.at = self.at[keep[self.place][self.run]]
        one = words.gram_hashes(self.hashes, self.k)[self.at] if len(self.at) else np.empty(0, np.uint64)
        two = words.gram_hashes(words.word_hashes(self.texts, seed=1)[0], self.k)[self.at] if len(self.at) else one
        one, two = one >> np.uint64(64 - hash_bits), (two >> np.uint64(64 - hash_bits // 2)).astype("<u4")
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.ones(len(order), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.one, self.two, first = one[new], two[new], self.at[order[new]]
        self.begins = np.cumsum(self.counts) - self.counts
        doc = np.array(self.ids, "<i8")
        self.first_nth = self.nth[self.row[first]]
        self.first_doc, self.first_place = doc[self.row[first]], (first - self.begins[self.row[first]]).astype("<i4")


def _kept(table: pa.Table, spans: Iterable[dict]) -> list[tuple]:
    """A block's rows of the result, without the words of its spans."""
    ids, _, texts = _rows(table)
    of_row = defaultdict(list)
    for r in spans:
        of_row[r["row"]].append((r["start"], r["n"]))
    rows = []
    for at, (i, t) in enumerate(zip(ids, texts)):
        ws = t.split()
        gone = np.zeros(len(ws), bool)
        for start, n in of_row.get(at, ()):
            gone[start : start + n] = True
        kept = [w for w, g in zip(ws, gone.tolist()) if not g] if at in of_row else ws
        rows.append((i, len(ws), len(ws) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return rows


def _refuted(table: pa.Table, asked: list[tuple]) -> list[tuple]:
    """Those of (id, place among its rows, start, n, digest) that a block's words don't bear out."""
    wanted = defaultdict(list)
    for doc, nth, *span in asked:
        wanted[doc, nth].append(span)
    ids, nth, texts = _rows(table) if wanted else ([], np.empty(0, np.int64), [])
    at = {(i, m): k for k, (i, m) in enumerate(zip(ids, nth.tolist()))}
    rows = []
    for (i, m), some in wanted.items():
        split = texts[at[i, m]].split()
        rows += [(i, m, a, n, d) for a, n, d in some if _digest(split[a : a + n]) != d]
    return rows


def remove_repeats(docs: DataFrame, k: int = 13, hash_bits: int = 64) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs(doc_id, text)``.

    Each word covered by a window of k consecutive words whose sequence also
    starts in a document with a smaller doc_id is removed; windows are judged
    on the input. kept_sha256 is over the kept words joined by one space.

    1. Documents are dealt into blocks, which exchange packed lists of anchors
       (the smallest hash among a window's runs of 5 words, the same in equal
       windows): an anchor in one document only has no repeated window.
    2. The other windows are edges; their 96-bit hashes go to the task of their
       range, which answers with the smallest source coordinate of each.
    3. Edges with consecutive places here and at the source compact into spans.
    4. Each distinct source span goes to the block that holds it, where its words
       are compared (by a digest of their bytes) in the pass that removes words.
       If one fails (hashes of different windows have met), spans are made
       again, and those that fail are judged window by window, by digests of
       the windows' words. Exact at any ``hash_bits``; few make hashes meet, for
       tests.

    Null, empty and wordless texts have 0 words. Rows without an id lose
    nothing and are no source. Rows that share an id don't affect each other.
    An empty table gives an empty result. Further columns are ignored.
    """
    dealt, spans, block = _compacted(docs, k, hash_bits)
    own = F.struct("block", F.col("row").alias("row"), "start", "n", F.lit(None).cast("long").alias("doc"), F.lit(None).cast("long").alias("nth"), F.lit(None).cast("binary").alias("digest"))
    asked = F.struct(block("src_doc", F.col("src_nth")).alias("block"), F.lit(-1).alias("row"), F.col("src_start").alias("start"), "n", F.col("src_doc").alias("doc"), F.col("src_nth").alias("nth"), "digest")
    sent = spans.select(F.inline(F.array(own, asked))).distinct()

    def judge(table: pa.Table, found: pa.Table) -> pa.Table:
        rows = found.to_pylist()
        kept = [(*r, False) for r in _kept(table, (r for r in rows if r["row"] >= 0))]
        if _refuted(table, [(r["doc"], r["nth"], r["start"], r["n"], r["digest"]) for r in rows if r["row"] < 0]):
            kept.append((None, None, None, None, True))
        return _table(kept, _JUDGED)

    judged = written(dealt.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(judge, _SQL["judged"]), "repeats-judged")
    if judged.where("refuted").isEmpty():
        named = judged.where("NOT refuted").drop("refuted")
    else:
        removed, dealt = _spans(docs, k, hash_bits)
        named = dealt.groupBy("block").cogroup(removed.groupBy("block")).applyInArrow(lambda t, f: _table(_kept(t, f.to_pylist()), _RESULT), _SQL["result"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept = [t.split() for t in blocks.texts_of(batch)]
            yield pa.RecordBatch.from_pylist([dict(zip(_RESULT.names, (None, len(ws), 0, hashlib.sha256(b" ".join(ws)).hexdigest()))) for ws in kept], _RESULT)

    nameless = docs.where(F.col("doc_id").isNull()).select("text").mapInArrow(whole, _SQL["result"])
    return named.unionAll(nameless)


def repeated_spans(docs: DataFrame, k: int = 13) -> DataFrame:
    """(doc_id, start, n, src_doc, src_start): the verified spans of words of ``remove_repeats``, places in words.

    Rows that share an id give spans under the same id.
    """
    removed, dealt = _spans(docs, k)

    def name(table: pa.Table, found: pa.Table) -> pa.Table:
        ids, _, _ = _rows(table)
        return _table([(ids[r["row"]], r["start"], r["n"], r["src_doc"], r["src_start"]) for r in found.to_pylist()], pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n", "src_doc", "src_start")]))

    return dealt.groupBy("block").cogroup(removed.groupBy("block")).applyInArrow(name, "doc_id long, start long, n long, src_doc long, src_start long")


def _compacted(docs: DataFrame, k: int, hash_bits: int) -> tuple[DataFrame, DataFrame, Callable]:
    """Documents dealt into blocks, spans yet to be verified, and the block of an id and its place (``nth``)."""
    if k < ANCHOR:
        raise ValueError(f"windows have {ANCHOR} words at least")
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    n_bytes, n_words = blocks.corpus_size(docs)
    n_blocks, n_ranges = blocks.sizes(n_bytes, n_words)
    bits = blocks.key_bits(n_words)
    block = lambda doc_id, nth: blocks.block_of(n_blocks, F.col(doc_id), nth.bitwiseAND(F.lit(0xFFFF).cast("long")))
    salt = F.xxhash64("text").bitwiseAND(F.lit(0xFFFF).cast("long"))
    dealt = docs.select(block("doc_id", salt).alias("block"), "doc_id", salt.cast("int").alias("salt"), "text")

    def send_anchors(table: pa.Table) -> pa.Table:
        block, w = table.column("block")[0].as_py(), _Windows(table, k, bits)
        edges = blocks.cuts(w.keys, n_ranges, bits)
        return _table([(block, "anchor", p, b - a, blocks.pack_keys(w.keys[a:b]), None, None, None, None) for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a], _LISTS)

    def meet_anchors(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        _, place, count = np.unique(np.concatenate([blocks.unpack_keys(r["one"], r["size"]) for r in rows]), return_inverse=True, return_counts=True)
        parts = np.split(count[place] > 1, np.cumsum([r["size"] for r in rows])[:-1])
        return _table([(r["block"], "anchor", r["part"], r["size"], np.packbits(p).tobytes(), None, None, None, None) for r, p in zip(rows, parts)], _LISTS)

    def send_edges(table: pa.Table, back: pa.Table) -> pa.Table:
        block, w = table.column("block")[0].as_py(), _Windows(table, k, bits)
        w.choose(back.to_pylist(), hash_bits)
        edges = blocks.cuts(w.one, n_ranges, 64)
        return _table([(block, "edge", p, b - a, blocks.pack_keys(w.one[a:b]), w.two[a:b].tobytes(), *(blocks.pack(c[a:b]) for c in (w.first_doc, w.first_nth, w.first_place))) for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a], _LISTS)

    def meet_edges(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        one = np.concatenate([blocks.unpack_keys(r["one"], r["size"]) for r in rows])
        two = np.concatenate([np.frombuffer(r["two"], "<u4") for r in rows])
        doc, nth, place = (np.concatenate([blocks.unpack(r[c], r["size"]).view("<i8") for r in rows]) for c in ("doc", "nth", "place"))
        order = np.lexsort((place, nth, doc, two, one))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)
        head = order[new][np.cumsum(new) - 1]
        best = np.empty(len(order), np.int64)
        best[order] = head
        ends = np.cumsum([r["size"] for r in rows])[:-1]
        return _table([(r["block"], "edge", r["part"], r["size"], None, None, *map(blocks.pack, some)) for r, *some in zip(rows, *(np.split(c[best], ends) for c in (doc, nth, place)))], _LISTS)

    def compact(table: pa.Table, back: pa.Table) -> pa.Table:
        block, w = table.column("block")[0].as_py(), _Windows(table, k, bits)
        answers = back.to_pylist()
        w.choose([r for r in answers if r["kind"] == "anchor"], hash_bits)
        got = sorted((r for r in answers if r["kind"] == "edge"), key=lambda r: r["part"])
        src_doc, src_nth, src_place = (np.concatenate([np.empty(0, "<i8"), *(blocks.unpack(r[c], r["size"]).view("<i8") for r in got)])[w.group] for c in ("doc", "nth", "place"))
        row = w.row[w.at]
        own = np.array(w.ids, np.int64)[row]
        gone = src_doc < own
        at, row, src_doc, src_nth, src_place = (c[gone] for c in (w.at, row, src_doc, src_nth, src_place))
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(row) != 0) | (np.diff(src_doc) != 0) | (np.diff(src_nth) != 0) | (np.diff(src_place) != 1)
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(at))) + k - 1
        rows, split, last = [], [], -1
        for r, a, n, d, m, p in zip(row[start].tolist(), (at - w.begins[row])[start].tolist(), size.tolist(), *(c[start].tolist() for c in (src_doc, src_nth, src_place))):
            if r != last:
                split, last = w.texts[r].split(), r
            rows.append((block, r, a, n, d, m, p, _digest(split[a : a + n])))
        return _table(rows, _SPANS)

    anchors = dealt.groupBy("block").applyInArrow(send_anchors, _SQL["lists"]).groupBy("part").applyInArrow(meet_anchors, _SQL["lists"])
    edges = dealt.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(send_edges, _SQL["lists"]).groupBy("part").applyInArrow(meet_edges, _SQL["lists"])
    return dealt, dealt.groupBy("block").cogroup(anchors.unionAll(edges).groupBy("block")).applyInArrow(compact, _SQL["spans"]), block


def _spans(docs: DataFrame, k: int, hash_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The verified spans, and the documents dealt into blocks."""
    dealt, spans, block = _compacted(docs, k, hash_bits)
    spans = written(spans, "repeat-spans")

    def refute(table: pa.Table, asked: pa.Table) -> pa.Table:
        return _table(_refuted(table, [tuple(r[c] for c in _ASKED.names) for r in asked.to_pylist()]), _ASKED)

    source = ["src_doc", "src_nth", "src_start", "n", "digest"]
    asked = spans.select(*source).distinct().withColumn("block", block("src_doc", F.col("src_nth")))
    refuted = written(dealt.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(refute, _SQL["asked"]), "refuted-spans")
    found = ["block", "row", "start", "n", "src_doc", "src_start"]
    if refuted.isEmpty():
        return spans.select(*found), dealt
    kept = spans.join(refuted, source, "left_anti").select(*found)
    return kept.unionByName(_by_digest(dealt, spans.join(refuted, source, "left_semi"), k).select(*found)), dealt


def _by_digest(dealt: DataFrame, failed: DataFrame, k: int) -> DataFrame:
    """Spans of k words: the windows in ``failed`` spans that also start in a document with a smaller id, by digests of their words."""

    def windows(table: pa.Table, within: pa.Table | None) -> pa.Table:
        ids, nth, texts = _rows(table)
        spans = defaultdict(set)
        for r in within.to_pylist() if within else ():
            spans[r["row"]].update(range(r["start"], r["start"] + r["n"] - k + 1))
        block, rows = table.column("block")[0].as_py() if len(table) else 0, []
        for k_, (i, m, t) in enumerate(zip(ids, nth.tolist(), texts)):
            if within and k_ not in spans:
                continue
            split = t.split()
            rows += [(block, k_, a, i, m, _digest(split[a : a + k])) for a in (sorted(spans[k_]) if within else range(len(split) - k + 1))]
        return _table(rows, _WINDOWS)

    own = dealt.groupBy("block").cogroup(failed.groupBy("block")).applyInArrow(lambda t, f: windows(t, f) if len(f) else _table([], _WINDOWS), _SQL["windows"])
    every = dealt.groupBy("block").applyInArrow(lambda t: windows(t, None), _SQL["windows"])
    first = every.join(own.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.min(F.struct("doc", "nth", "start")).alias("first"))
    return own.join(first, "digest").where("first.doc < doc").select("block", "row", "start", F.lit(k).cast("long").alias("n"), F.col("first.doc").alias("src_doc"), F.col("first.start").alias("src_start"))
