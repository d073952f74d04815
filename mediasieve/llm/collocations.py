"""Phrase collocations: counts of bounded-depth substrings from a suffix automaton a shard, reduced over all shards.

Texts are sequences of words here, cut at punctuation. The states of a
generalised suffix automaton are the classes of substrings that end at the same
positions, and a state's suffix link leads to its longest suffix that ends at
more of them. Both are read off the sorted list of reversed contexts: a
substring's end positions are the run of contexts that begin with its reversal,
so a run within a run is a link, and equal runs are one state.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mediasieve.llm import blocks, words
from mediasieve.llm.batches import bound_batches, give_back, slices
from mediasieve.llm.scratch import written

#: Bytes of a text's parts.
PART_BYTES = 1 << 20
#: Salts of the rows that hold the counts of single words: candidates with one frequent word are many.
WORD_SALTS = 16
_SENT = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("size", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_BACK = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("size", pa.int32()), ("frequent", pa.binary())])
_WORD, _GAP, _END = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = _GAP
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _END
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BREAK = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
_ENDS = [bytes([c]) for c in b".,;:!?\n\x0b\x0c\r"]


@dataclass
class Level:
    """Substrings of one length: the words' codes (last first), how many positions each ends at, and its longest proper suffix one level up."""

    codes: list[np.ndarray]
    endpos: np.ndarray
    link: np.ndarray


def automaton(codes: np.ndarray, piece: np.ndarray, counted: np.ndarray, depth: int) -> list[Level]:
    """The substrings of up to ``depth`` words of word codes (from 1) that end at a counted position and lie in one piece.

    Level d holds those of d + 1 words. Contexts are compared as packed 64-bit
    integers where those hold ``depth`` codes, otherwise column by column.
    """
    ends = np.flatnonzero(counted)
    context = [codes[ends]]
    for d in range(1, depth):
        at = np.maximum(ends - d, 0)
        context.append(np.where((ends >= d) & (piece[at] == piece[ends]), codes[at], 0))
    bits = int(codes.max(initial=1)).bit_length()
    if bits * depth < 64:
        packed = np.zeros(len(ends), np.uint64)
        for column in context:
            packed = packed << np.uint64(bits) | column.astype(np.uint64)
        packed.sort()
        mask = np.uint64((1 << bits) - 1)
        context = [(packed >> np.uint64(bits * (depth - 1 - d)) & mask).astype(np.int64) for d in range(depth)]
    else:
        order = np.lexsort(context[::-1])
        context = [column[order] for column in context]
    levels: list[Level] = []
    new = np.zeros(len(ends), bool)
    above = np.zeros(len(ends), np.int64)
    for d in range(depth):
        if len(new):
            new[0] = True
            new[1:] |= context[d][1:] != context[d][:-1]
        first = np.flatnonzero(new)
        runs = np.diff(first, append=len(ends))
        real = context[d][first] > 0  # a context that is shorter is no substring of this length
        levels.append(Level([context[j][first[real]] for j in range(d + 1)], runs[real], above[first[real]]))
        number = np.cumsum(real) - 1
        above = np.repeat(number, runs)
    return levels


def states(levels: list[Level]) -> list[np.ndarray]:
    """Whether each substring is the longest of its state: no longer one ends at the same positions."""
    longest = [np.ones(len(level.endpos), bool) for level in levels]
    for d in range(len(levels) - 1, 0, -1):
        same = levels[d].endpos == levels[d - 1].endpos[levels[d].link]
        longest[d - 1][levels[d].link[same]] = False
    return longest


def _parts(text: bytes, limit: int, depth: int) -> Iterator[tuple[bytes, int]]:
    """A text in parts of about ``limit`` bytes, cut between words. A part repeats the last depth - 1 words of its piece; their number is given."""
    at, context = 0, b""
    while True:
        cut = _BREAK.search(text, at + limit) if len(text) - at > limit else None
        part = context + text[at : cut.start() if cut else len(text)]
        yield part, len(context.split())
        if not cut:
            return
        at = cut.start()
        rest = part[max(map(part.rfind, _ENDS)) + 1 :].replace(b"\t", b" ").split(b" ")
        words = [w for w in rest if w][-(depth - 1) :] if depth > 1 else []
        context = b" ".join(words)


def shard_levels(parts: list[tuple[str, bytes, int]], depth: int) -> Iterator[tuple[str, int, pa.Array, list[Level]]]:
    """For each language of a shard of (lang, part of a text, words of it that only give context): its number of words, the shard's vocabulary, and the substrings."""
    buf = np.frombuffer(b"\n".join(t for _, t, _ in parts), np.uint8)
    kind = _KIND[buf]
    word = kind == _WORD
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    first, last = edges[0::2], edges[1::2]
    offsets = np.zeros(len(first) + 1, np.int32)
    np.cumsum(last - first, out=offsets[1:])
    data = _LOWER[buf[word]]
    encoded = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    codes = encoded.indices.to_numpy().astype(np.int64) + 1
    piece = np.cumsum(kind == _END)[first] if len(first) else np.empty(0, np.int64)
    begins = np.cumsum([0, *(len(t) + 1 for _, t, _ in parts[:-1])])
    of = np.searchsorted(begins, first, side="right") - 1
    nth = np.arange(len(first)) - np.searchsorted(first, begins)[of]
    fresh = nth >= np.array([c for _, _, c in parts])[of]
    langs = sorted({lang for lang, _, _ in parts})
    number = {lang: j for j, lang in enumerate(langs)}
    lang_of = np.array([number[lang] for lang, _, _ in parts])[of]
    del buf, kind, word, edges, last, offsets, data, begins, nth
    for j, lang in enumerate(langs):
        counted = fresh & (lang_of == j)
        yield lang, int(counted.sum()), encoded.dictionary, automaton(codes, piece, counted, depth)


def _keys(lang: str, vocabulary: pa.Array, levels: list[Level], bits: int) -> np.ndarray:
    """Hashes of the substrings of all levels by language and words."""
    hashes = words.word_hashes([b" ".join(vocabulary.to_pylist())])[0]
    seed = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
    found = [np.empty(0, np.uint64)]
    for level in levels:
        h = np.full(len(level.endpos), seed + np.uint64(len(level.codes)))
        for c in reversed(level.codes):
            h = words.mix(h) + hashes[c - 1]
        found.append(words.mix(h) >> np.uint64(64 - bits))
    return np.concatenate(found)


def _cut_texts(docs: DataFrame, n_blocks: int, depth: int) -> DataFrame:
    """(block, lang, part, context): texts in parts of PART_BYTES, dealt by their bytes and place in the task, so that equal rows spread."""
    schema = pa.schema([("block", pa.int32()), ("lang", pa.string()), ("part", pa.binary()), ("context", pa.int32())])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in slices(batches, 64):
            rows = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                for part, context in _parts(text, PART_BYTES, depth):
                    rows.append(((zlib.crc32(part) + at * 0x9E3779B1) % n_blocks, lang, part, context))
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "block int, lang string, part binary, context int")


def _shard(table: pa.Table) -> list[tuple[str, bytes, int]]:
    give_back()
    return list(zip(*(table.column(c).to_pylist() for c in ("lang", "part", "context"))))


def phrase_counts(docs: DataFrame, depth: int, min_count: int, shard_bytes: float = blocks.BLOCK_BYTES, range_keys: float = blocks.RANGE_KEYS) -> DataFrame:
    """(lang, size, phrase, f) with size 0 for all words of a language, and every phrase of up to ``depth`` words with f >= ``min_count``.

    A shard sends the hash keys and counts of its substrings as packed lists,
    and learns which of them may be frequent in all shards together. Those it
    sends as words, and the sum decides. Keys have 4 bits more than their
    number needs: of the rare substrings one in 160 at most shares the key of a
    frequent one and is sent for nothing.
    """
    docs = docs.select("lang", "text")
    n_bytes = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n_keys = n_bytes * depth // 6 + 1
    bits = min(64, max(24, n_keys.bit_length() + 4))
    n_blocks = max(1, math.ceil(n_bytes / shard_bytes))
    n_ranges = 1 << max(0, math.ceil(math.log2(n_keys / range_keys)))
    dealt = _cut_texts(docs, n_blocks, depth)

    def shard_keys(shard: list[tuple[str, bytes, int]]):
        """Languages with their words and substrings; the distinct keys, where each substring's key is among them, and counts."""
        found = list(shard_levels(shard, depth))
        keys, place = np.unique(np.concatenate([_keys(lang, names, levels, bits) for lang, _, names, levels in found]), return_inverse=True)
        counts = np.concatenate([level.endpos for *_, levels in found for level in levels])
        return found, keys, place, np.bincount(place, counts, len(keys)).astype(np.int64)

    def send(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        _, keys, _, counts = shard_keys(_shard(table))
        edges = blocks.cuts(keys, n_ranges, bits)
        rows = [(block, k, b - a, blocks.pack_keys(keys[a:b]), blocks.pack(counts[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
        return _table(rows, _SENT)

    def judge(table: pa.Table) -> pa.Table:
        give_back()
        rows = table.select(["block", "part", "size"]).to_pylist()
        sizes = [r["size"] for r in rows]
        unpacked = lambda name, f: np.concatenate([f(v.as_py(), n) for v, n in zip(table.column(name), sizes)])
        _, place = np.unique(unpacked("keys", blocks.unpack_keys), return_inverse=True)
        frequent = (np.bincount(place, unpacked("counts", blocks.unpack)) >= min_count)[place]
        back = [np.packbits(p).tobytes() for p in np.split(frequent, np.cumsum(sizes)[:-1])]
        return _table([(*r.values(), b) for r, b in zip(rows, back)], _BACK)

    def name(table: pa.Table, answers: pa.Table) -> pa.Table:
        found, keys, place, _ = shard_keys(_shard(table))
        back = sorted(answers.to_pylist(), key=lambda r: r["part"])
        flags = np.concatenate([np.empty(0, bool), *(np.unpackbits(np.frombuffer(r["frequent"], np.uint8), count=r["size"]).astype(bool) for r in back)])[place]
        out, at = [], 0
        for lang, n, vocabulary, levels in found:
            vocabulary = vocabulary.cast(pa.string())
            out.append(_counted(lang, 0, pa.array([""]), np.array([n])))
            for level in levels:
                kept = np.flatnonzero(flags[at : at + len(level.endpos)])
                at += len(level.endpos)
                parts = [vocabulary.take(pa.array(c[kept] - 1)) for c in reversed(level.codes)]
                out.append(_counted(lang, len(parts), pc.binary_join_element_wise(*parts, " ") if len(parts) > 1 else parts[0], level.endpos[kept]))
        return pa.concat_tables(out)

    bound_batches(docs.sparkSession)
    answers = dealt.groupBy("block").applyInArrow(send, "block int, part int, size int, keys binary, counts binary").groupBy("part").applyInArrow(judge, "block int, part int, size int, frequent binary")
    named = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(name, "lang string, size int, phrase string, f long")
    return named.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= min_count) | (F.col("size") == 0))


def _counted(lang: str, size: int, phrases: pa.Array, f: np.ndarray) -> pa.Table:
    n = len(f)
    return pa.table({"lang": pa.array([lang] * n, pa.string()), "size": pa.array(np.full(n, size, np.int32)), "phrase": phrases, "f": pa.array(f.astype(np.int64))})


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _score(a: str, left: str, right: str) -> str:
    """floor(1000000 a^2 / (l r)) in decimals of 38 digits: exact for counts up to 10^16."""
    wide = "CAST({} AS DECIMAL(19, 0))".format
    return f"CAST(({wide(a)} * {wide(a)} * CAST(1000000 AS DECIMAL(7, 0))) DIV ({wide(left)} * {wide(right)}) AS BIGINT)"


def score_phrases(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of each phrase of two words or more, by its lowest-scoring cut.

    ``frequent(lang, size, phrase, f)`` must hold every part of its phrases,
    which are at least as frequent as they are. Parts are joined by salted keys:
    a phrase asks for a word's count under a salt of its own.
    """
    salts = F.when(F.col("size") == 1, WORD_SALTS).otherwise(1)
    counts = frequent.where("size >= 1").select("lang", F.col("phrase").alias("part"), F.col("f").alias("n_part"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    words = F.split("phrase", " ", -1)
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    halves = frequent.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("words"), cut)
    part = lambda start, n: F.struct(F.array_join(F.slice("words", start, n), " ").alias("part"), (n == 1).alias("word"))
    sides = F.posexplode(F.array(part(F.lit(1), F.col("k")), part(F.col("k") + 1, F.col("size") - F.col("k")))).alias("side", "half")
    asked = halves.select("lang", "phrase", "size", "a", "k", sides)
    salt = F.when(F.col("half.word"), F.pmod(F.xxhash64("phrase"), F.lit(WORD_SALTS)).cast("int")).otherwise(0)
    asked = asked.select("lang", "phrase", "size", "a", "k", "side", F.col("half.part").alias("part"), salt.alias("salt"))
    side = lambda n: F.max(F.when(F.col("side") == n, F.col("n_part")))
    cuts = asked.join(counts, ["lang", "part", "salt"]).groupBy("lang", "phrase", "size", "a", "k").agg(side(0).alias("l"), side(1).alias("r"))
    lowest = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(F.expr(_score("a", "l", "r")).alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def drop_subsumed(scored: DataFrame, frequent: DataFrame, percent: int) -> DataFrame:
    """``scored`` without phrases that lie inside a longer one that is found at least ``percent`` % as often.

    Each longer phrase hands its count to what it contains: along its chain of
    suffix links (its suffixes) and that of each of its prefixes.
    """
    span = lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), span))
    longer = frequent.where("size >= 3").select("lang", "f", "size", F.split("phrase", " ", -1).alias("words"))
    held = longer.select("lang", "f", F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    return scored.join(held, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {int(percent)} * a").drop("longer")


def mine_collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, percent: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` best phrases of each language of ``docs(text, lang)``.

    Words are runs of anything but space, tab and the piece ends ``.,;:!?`` and
    line breaks, A-Z in lower case; a phrase is up to ``max_words`` words in one
    piece. Null texts are empty, null languages 'und'; repeated rows count each
    for itself; an empty table or one without frequent phrases gives no rows;
    further columns are ignored. Longer texts than a shard are cut between words
    and counted on with the words before the cut as context. Ties in score and
    count go to the phrase that is first in byte order.

    Each shard sends every distinct substring once, as a hash key, and as words
    only those that may have ``min_count`` occurrences in all shards; all parts
    of such a phrase are among them. The best of a language are found by salts first, so
    no task sorts a whole language.
    """
    frequent = written(phrase_counts(docs, max_words, min_count), "phrases")
    kept = drop_subsumed(score_phrases(frequent), frequent, percent)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    number = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(*order))
    some = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", number("lang", "salt")).where(F.col("rank") <= top)
    best = some.withColumn("rank", number("lang").cast("long")).where(F.col("rank") <= top)
    total = frequent.where("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
