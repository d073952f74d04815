"""Stupid-backoff language-model scores of documents, from counts of all documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasieve.llm import blocks, words
from mediasieve.llm.batches import bound_batches, give_back

_SENT = "block int, part int, size int, keys binary, counts binary"
_BACK = "block int, part int, size int, totals binary"
_CUT = "doc_id long, of long, piece int, lead int, copies long, text string"
_SCORED = "doc_id long, of long, piece int, copies long, n_words long, log_score double"
#: Longer texts are cut into pieces of about so many bytes.
PIECE_BYTES = 1 << 20


def _cut(docs: DataFrame, order: int, limit: int) -> DataFrame:
    """``docs(doc_id, text)`` in pieces between words, so that a text of any length is dealt into many blocks.

    ``of`` is a hash of the whole text. A piece repeats the last ``order`` - 1
    words before it, and ``lead`` is their number. Rows of a batch that are
    equal become one with a number of ``copies``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ofs, texts = batch.column(0), batch.column(1), batch.column(2)
            seen: dict[tuple, int] = {}
            first = [k for k, key in enumerate(zip(ids.to_pylist(), ofs.to_pylist())) if seen.setdefault(key, k) == k]
            copies = [1] * batch.num_rows
            if len(first) < batch.num_rows:
                for key in zip(ids.to_pylist(), ofs.to_pylist()):
                    copies[seen[key]] += 1
                copies = [n - 1 for n in copies]
            size = pc.binary_length(texts).to_pylist()
            short = [k for k in first if (size[k] or 0) <= limit]
            n = len(short)
            zero = pa.array(np.zeros(n, np.int32))
            columns = [c if n == batch.num_rows else c.take(pa.array(short, pa.int64())) for c in (ids, ofs, texts)]
            yield _batch([columns[0], columns[1], zero, zero, pa.array([copies[k] for k in short], pa.int64()), columns[2]])
            for k in first:
                if (size[k] or 0) > limit:
                    tail: list[bytes] = []
                    for nth, piece in enumerate(words.pieces(texts[k].as_py().encode(), limit)):
                        whole = b" ".join([*tail, piece])
                        row = [ids[k].as_py()], [ofs[k].as_py()], [nth], [len(tail)], [copies[k]], [whole.decode()]
                        yield _batch([pa.array(c, t) for c, t in zip(row, _TYPES)])
                        tail = [*tail, *piece.rsplit(None, order)][1 - order :] if order > 1 else []

    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("of"), "text")
    return hashed.mapInArrow(cut, _CUT)


_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string())


def _batch(columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "of", "piece", "lead", "copies", "text"])


def _grams(texts: list[bytes], order: int, bits: int):
    """The number of words of each text; for each n up to order, n-gram keys by position and the positions."""
    give_back()
    hashes, counts = words.word_hashes(texts)
    shift = np.uint64(64 - bits)
    out = []
    for n in range(1, order + 1):
        at = np.flatnonzero(words.runs_within(counts, n))
        out.append((words.gram_hashes(hashes, n)[at] >> shift, at))
    return counts, out


def stupid_backoff(docs: DataFrame, order: int = 3, backoff: float = 0.4, min_count: int = 2, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Score every whole text by a word n-gram model of all texts.

    The score of a word is count(n-gram) / count(n-gram without its last word)
    for the longest n-gram up to ``order`` words that ends at it and has
    ``min_count`` occurrences in the corpus, times ``backoff`` for each order
    given up; single words have no minimum and are divided by the number of all
    words. ``log_score`` sums natural logarithms, ``mean_log_score`` divides it
    by the number of words.

    The relational plan: documents are dealt into blocks; each block sends its
    distinct n-grams with counts to the task of their hash range, which holds
    that part of the count table; the totals come back to the block, where they
    are joined to the exploded n-grams and summed by document. Keys are
    hashes with 24 bits more than the number of n-grams needs. Texts of more
    than ``piece_bytes`` are dealt in pieces, whose sums are added up, and equal
    rows that lie together are dealt as one, so neither a long text nor a row
    that is repeated often makes a block large.

    Null or wordless text: 0 words, log_score 0, mean null. Repeated rows are
    documents of their own. An empty table gives an empty result. Further
    columns are ignored.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    n_bytes, n_words = blocks.corpus_size(docs)
    n_blocks, n_ranges = blocks.sizes(n_bytes, n_words)
    bits = blocks.key_bits(n_words)
    dealt = _cut(docs, order, piece_bytes).withColumn("block", blocks.block_of(n_blocks, F.col("doc_id"), F.col("piece"), F.col("text")))

    def send(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        lead, copies = (table.column(c).to_numpy() for c in ("lead", "copies"))
        sizes, grams = _grams(blocks.texts_of(table), order, bits)
        rows = []
        for n, (keys, at) in enumerate(grams):
            if lead.any() or (copies > 1).any():
                row = np.repeat(np.arange(len(sizes)), sizes)[at]
                new = at - (np.cumsum(sizes) - sizes)[row] + n >= lead[row]  # others are in the piece before
                keys, place = np.unique(keys, return_inverse=True)
                counts = np.bincount(place, new * copies[row], len(keys)).astype(np.int64)
            else:
                keys, counts = np.unique(keys, return_counts=True)
            edges = blocks.cuts(keys, n_ranges, bits)
            rows += [(block, n * n_ranges + k, b - a, blocks.pack_keys(keys[a:b]), blocks.pack(counts[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
        return _table(rows, ["block", "part", "size", "keys", "counts"], [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    def total(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        _, place = np.unique(np.concatenate([blocks.unpack_keys(r["keys"], r["size"]) for r in rows]), return_inverse=True)
        sums = np.bincount(place, np.concatenate([blocks.unpack(r["counts"], r["size"]) for r in rows])).astype(np.int64)[place]
        parts = np.split(sums, np.cumsum([r["size"] for r in rows])[:-1])
        return _table([(r["block"], r["part"], r["size"], blocks.pack(p)) for r, p in zip(rows, parts)], ["block", "part", "size", "totals"], [pa.int32(), pa.int32(), pa.int32(), pa.binary()])

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        counts, grams = _grams(blocks.texts_of(table), order, bits)
        got: list[list] = [[] for _ in range(order)]
        for r in sorted(answers.to_pylist(), key=lambda r: r["part"]):
            got[r["part"] // n_ranges].append(blocks.unpack(r["totals"], r["size"]).astype(np.int64))
        size = int(counts.sum())
        seen = np.zeros((order, size), np.int64)  # by n - 1 and the position of the first word
        for n, (keys, at) in enumerate(grams):
            if len(keys):
                seen[n, at] = np.concatenate(got[n])[np.unique(keys, return_inverse=True)[1]]
        logs = np.log(np.maximum(seen[0], 1)) - np.log(max(n_words, 1)) + (order - 1) * np.log(backoff)
        depth = np.arange(size) - np.repeat(np.cumsum(counts) - counts, counts)  # words before it in its text
        logs -= np.maximum(order - 1 - depth, 0) * np.log(backoff)  # no order is given up for want of words
        for n in range(1, order):
            at = np.flatnonzero(seen[n] >= min_count)
            end = at + n
            tried = np.minimum(order - 1, depth[end])
            logs[end] = np.log(seen[n, at]) - np.log(seen[n - 1, at]) + (tried - n) * np.log(backoff)
        lead = table.column("lead").to_numpy()
        if lead.any():
            logs[depth < np.repeat(lead, counts)] = 0  # scored in the piece before
        sums = np.bincount(np.repeat(np.arange(len(counts)), counts), logs, len(counts))
        return table.select(["doc_id", "of", "piece", "copies"]).append_column("n_words", pa.array(counts - lead)).append_column("log_score", pa.array(sums))

    answers = dealt.groupBy("block").applyInArrow(send, _SENT).groupBy("part").applyInArrow(total, _BACK)
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, _SCORED)
    copies = F.sum(F.when(F.col("piece") == 0, F.col("copies")))
    merged = scored.groupBy("doc_id", "of").agg(copies.alias("rows"), F.sum(F.col("n_words") * F.col("copies")).alias("n_words"), F.sum(F.col("log_score") * F.col("copies")).alias("log_score"))
    one = merged.select("doc_id", F.expr("n_words DIV rows").alias("n_words"), (F.col("log_score") / F.col("rows")).alias("log_score"), F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return one.select("doc_id", "n_words", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"))


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)
