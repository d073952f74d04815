"""Exact Jaccard join of documents on word n-grams, by vertical partitioning of the n-gram order."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasieve.llm import blocks, words
from mediasieve.llm.batches import bound_batches, give_back, slices
from mediasieve.llm.components import components
from mediasieve.llm.scratch import written

_UPPER_TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SENT = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("size", pa.int32()), ("keys", pa.binary()), ("values", pa.binary()), ("second", pa.binary())])
_BACK = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("size", pa.int32()), ("values", pa.binary())])
_ROWS = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("n", pa.int64()), ("rep", pa.int64()), ("v", pa.binary()), ("token", pa.int64()), ("rest", pa.int64()), ("fragment", pa.int32()), ("grams", pa.list_(pa.int64()))])
_SQL = {
    "sent": "block int, part int, size int, keys binary, values binary, second binary",
    "back": "block int, part int, size int, values binary",
    "rows": "kind string, doc_id long, n long, rep long, v binary, token long, rest long, fragment int, grams array<long>",
}
_LANES = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
_ROTATIONS, _TURNS = 8, 2
_DEALS, _REDEALS = 6, 2
BLOCK_BYTES = 4e6
#: Buckets in which more pairs would be compared are dealt anew.
MAX_PAIRS = 1 << 10


def gram_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-grams; of shorter texts, one for the whole sequence."""
    hashes, counts = words.word_hashes(t.translate(_UPPER_TO_LOWER) for t in texts)
    grams = words.gram_hashes(hashes, n)
    found, at = [], 0
    for c in counts.tolist():
        if c >= n:
            found.append(np.unique(grams[at : at + c - n + 1]))
        else:
            found.append(words.gram_hashes(hashes[at : at + c], c) ^ np.uint64(c) if c else np.empty(0, np.uint64))
        at += c
    return found


def _prints(sets: list[np.ndarray]) -> np.ndarray:
    """(n, 2): 128-bit fingerprints of sets."""
    sums = [[words.mix(s ^ lane).sum(dtype=np.uint64) for lane in _LANES] for s in sets]
    return words.mix(np.array(sums, np.uint64).reshape(-1, 2))


def _least_overlap(n: int, percent: int) -> int:
    """What two sets of which one has n elements must share at least."""
    return -(-percent * n // 100)


def _vertices(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Rows of three kinds: a ``doc`` for each document; ``prefix`` and ``segment`` rows for each distinct set that may have links. Ids aren't null."""
    n_bytes, n_words = blocks.corpus_size(docs)
    n_blocks, n_ranges = blocks.sizes(n_bytes, n_words, block_bytes=BLOCK_BYTES)
    n_prints = max(1, n_ranges >> 6)
    bits = blocks.key_bits(n_words)
    shift = np.uint64(64 - bits)
    dealt = docs.select(blocks.block_of(n_blocks, F.col("doc_id"), F.col("text")).alias("block"), "doc_id", "text")

    def read(table: pa.Table):
        """Ids and sets; the distinct keys of all sets with place and count; fingerprints of the sets with an element."""
        give_back()
        ids = table.column("doc_id").to_pylist()
        sets = gram_sets(blocks.texts_of(table), n)
        keys, place, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]) >> shift, return_inverse=True, return_counts=True)
        own = [k for k, s in enumerate(sets) if len(s)]
        prints = _prints([sets[k] for k in own])
        # Documents of the same set together, smallest id first.
        order = np.lexsort((np.array([ids[k] for k in own], np.int64), prints[:, 1], prints[:, 0]))
        first = np.ones(len(own), bool)
        first[1:] = (np.diff(prints[order], axis=0) != 0).any(axis=1)
        return ids, sets, keys, place, counts, [own[k] for k in order], prints[order], first

    def send(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        ids, _, keys, _, counts, own, prints, first = read(table)
        edges = blocks.cuts(keys, n_ranges, bits)
        rows = [(block, k, b - a, blocks.pack_keys(keys[a:b]), blocks.pack(counts[a:b]), b"") for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
        prints, least = prints[first], np.array([ids[k] for k in own], "<i8")[first]
        edges = blocks.cuts(prints[:, 0], n_prints, 64)
        rows += [(block, n_ranges + k, b - a, prints[a:b, 0].astype("<u8").tobytes(), least[a:b].tobytes(), prints[a:b, 1].astype("<u8").tobytes()) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
        return _table(rows, _SENT)

    def total(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        sizes = [r["size"] for r in rows]
        if rows[0]["part"] < n_ranges:  # in how many documents each n-gram is
            _, place = np.unique(np.concatenate([blocks.unpack_keys(r["keys"], r["size"]) for r in rows]), return_inverse=True)
            sums = np.bincount(place, np.concatenate([blocks.unpack(r["values"], r["size"]) for r in rows])).astype(np.int64)[place]
            back = [blocks.pack(p) for p in np.split(sums, np.cumsum(sizes)[:-1])]
        else:  # the smallest id of each set, and whether this block is the first that has it
            one, two, least = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("keys", "<u8"), ("second", "<u8"), ("values", "<i8")))
            order = np.lexsort((np.repeat([r["block"] for r in rows], sizes), least, two, one))
            group = np.cumsum(np.concatenate([[0], (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)]))
            start = np.flatnonzero(np.diff(group, prepend=-1))
            best, owner = np.empty(len(order), "<i8"), np.zeros(len(order), bool)
            best[order] = least[order][start][group]
            owner[order[start]] = True
            ends = np.cumsum(sizes)[:-1]
            back = [p.tobytes() + o.tobytes() for p, o in zip(np.split(best, ends), np.split(owner, ends))]
        return _table([(r["block"], r["part"], r["size"], b) for r, b in zip(rows, back)], _BACK)

    def emit(table: pa.Table, answers: pa.Table) -> pa.Table:
        ids, sets, _, place, _, own, prints, first = read(table)
        got = sorted(answers.to_pylist(), key=lambda r: r["part"])
        freq = np.concatenate([np.empty(0, np.int64), *(blocks.unpack(r["values"], r["size"]).astype(np.int64) for r in got if r["part"] < n_ranges)])[place]
        least = np.concatenate([np.empty(0, "<i8"), *(np.frombuffer(r["values"], "<i8", r["size"]) for r in got if r["part"] >= n_ranges)])
        owner = np.concatenate([np.empty(0, bool), *(np.frombuffer(r["values"], bool, offset=8 * r["size"]) for r in got if r["part"] >= n_ranges)])
        ends = np.cumsum([0, *map(len, sets)])
        rows = [("doc", i, 0, i, None, None, None, None, None) for i, s in zip(ids, sets) if not len(s)]
        group = np.cumsum(first) - 1
        for k, g, head, pair in zip(own, group.tolist(), first.tolist(), prints):
            s, rep = sets[k], int(least[g])
            # Only rows that share an id can have the same smallest id and other sets: half of the fingerprint tells them apart.
            v = (rep + (1 << 63)).to_bytes(8, "big") + int(pair[0]).to_bytes(8, "big")
            rows.append(("doc", ids[k], len(s), rep, v, None, None, None, None))
            if not head or not owner[g]:
                continue
            f = freq[ends[k] : ends[k + 1]]
            shared = f >= 2
            # What only this document has is in no overlap, so enough of the set must be in others, too.
            if int(shared.sum()) < _least_overlap(len(s), percent):
                continue
            order = np.lexsort((s, f))  # the global order: rarest first, then by hash
            prefix = order[: len(s) - _least_overlap(len(s), percent) + 1]
            places = np.flatnonzero(shared[prefix])
            rows += [("prefix", None, len(s), rep, v, t, r, None, None) for t, r in zip(s[prefix[places]].view(np.int64).tolist(), (len(s) - places).tolist())]
            band = np.log2(f).astype(np.int32)
            rows += [("segment", None, len(s), rep, v, None, None, b, s[band == b].view(np.int64)) for b in np.unique(band[shared]).tolist()]
        return _table(rows, _ROWS)

    answers = dealt.groupBy("block").applyInArrow(send, _SQL["sent"]).groupBy("part").applyInArrow(total, _SQL["back"])
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(emit, _SQL["rows"])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _alike(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, na, b, nb)`` that are linked: partial overlaps are counted by fragment and summed for each pair."""
    left = segments.select(F.col("v").alias("a"), "fragment", F.col("grams").alias("a_grams"))
    right = segments.select(F.col("v").alias("b"), "fragment", F.col("grams").alias("b_grams"))
    counted = (
        pairs.join(left, "a")
        .join(right, ["b", "fragment"])
        .select("a", "b", "na", "nb", F.size(F.array_intersect("a_grams", "b_grams")).alias("part"))
        .groupBy("a", "b", "na", "nb")
        .agg(F.sum("part").alias("shared"))
    )
    return counted.where(100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def _may_link(percent: int) -> Column:
    """Whether (n, rest) and (m, w_rest) may be of linked sets that first meet at this n-gram.

    ``rest`` counts a set's n-grams from this one on, so the smaller of both
    bounds the overlap, which must reach percent / (100 + percent) of n + m.
    The first n-gram that two sets share passes whenever they are linked.
    """
    return (100 + percent) * F.least("rest", "w_rest") >= percent * (F.col("n") + F.col("m"))


def _other() -> list[Column]:
    """The columns of a vertex as the other side of a pair."""
    return [F.col(c).alias(name) for c, name in (("v", "w"), ("n", "m"), ("rest", "w_rest"), ("label", "w_label"))]


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (v, n, w, m), smaller vertex first."""
    near = pairs.where(F.col("v") != F.col("w"))
    first = F.col("v") < F.col("w")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return near.select(pick("v", "w").alias("a"), pick("n", "m").alias("na"), pick("w", "v").alias("b"), pick("m", "n").alias("nb")).distinct()


def _size_classes(largest: int) -> list[int]:
    """Sizes at which classes begin, a tenth or one larger than the one before, beyond ``largest``."""
    begins = [1]
    while begins[-1] <= largest:
        begins.append(max(begins[-1] + 1, begins[-1] * 11 // 10))
    return begins


@cache
def _spare_parts(n: int, k: int) -> int:
    """How many parts more than k a band of sets of at least n dealt n-grams gets: so many that a fifth of the sets at most has as many empty parts, if k / 2 do for that."""
    spare = 1
    while spare < k // 2 + 2:
        mean = (k + spare) * (1 - 1 / (k + spare)) ** n
        if mean > 15:
            rare = spare >= mean + 0.85 * math.sqrt(mean)
        else:
            rare = 1 - sum(math.exp(-mean) * mean**e / math.factorial(e) for e in range(min(spare, 60))) <= 0.2
        if rare:
            break
        spare += 1 + spare // 16
    return spare


def _tokens(grams: np.ndarray, size_class: int, k: int, spare: int, seed: int) -> np.ndarray:
    """Names of parts of a set's n-grams; linked sets of which the larger is of the class have one in common at least."""
    found, sum_by, parts = [], words.mix(grams ^ _LANES[1]), k + spare
    for deal in range(_DEALS):
        lane = np.uint64(int(_LANES[0]) * (2 * (seed * _DEALS + deal) + 1) % (1 << 64))
        part = (words.mix(grams ^ lane) % np.uint64(parts)).astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        np.bitwise_xor.at(sums, part, sum_by)
        full = np.bincount(part, minlength=parts) > 0
        few = parts - int(full.sum()) < spare
        taken = np.flatnonzero(full) if few or deal < _DEALS - 1 else np.arange(parts)
        name = (taken.astype(np.uint64) + np.uint64((size_class * _DEALS + deal) << 32)) * lane
        found.append(words.mix(sums[taken] + words.mix(name)))
        if few:
            break
    return np.concatenate(found)


def _parts(members: DataFrame, segments: DataFrame, percent: int, seed: int = 0) -> DataFrame:
    """(token, v, n, rest, label): the parts of ``members(v, n, rest, label)`` of which linked sets have one in common.

    Linked sets of which the larger is of a size class differ in at most k
    n-grams; each set is dealt for its own class and for those of larger sets
    that it may be linked with. Its n-grams are dealt by hash into k + s parts:
    s parts at least are the same in both. Only parts that hold n-grams have
    tokens: if one of the two sets has fewer than s empty parts, a part with
    n-grams is among the equal ones. A set that has more is dealt again by
    another hash, and again; two sets that are linked meet in the first deal in
    which one of them has few empty parts, as both are dealt that often. Only
    after _DEALS such deals (a fifth of the sets needs the next) empty parts
    have tokens, too. A token names deal, class, part and the n-grams in it (by
    the sum of their hashes; other n-grams of the same sum are only further
    candidates). N-grams of one set alone aren't dealt: they are among those in
    which it differs. ``rest`` bounds what a set can share at all: a class that
    is too large for it gets none of its parts.
    """
    schema = pa.schema([("token", pa.int64()), ("v", pa.binary()), ("n", pa.int64()), ("rest", pa.int64()), ("label", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows, tokens = [], []
            begins = _size_classes(100 * max(batch.column("n").to_pylist(), default=1) // percent + 1)
            for at, (n, rest) in enumerate(zip(batch.column("n").to_pylist(), batch.column("rest").to_pylist())):
                grams = batch.column("grams")[at].values.to_numpy().view(np.uint64)
                own = bisect_right(begins, n) - 1
                for c in range(own, bisect_right(begins, 100 * n // percent)):
                    other = _least_overlap(n, percent) if c == own else begins[c]
                    if (100 + percent) * rest < percent * (n + other):
                        continue
                    k = 2 * (begins[c + 1] - 1) * (100 - percent) // (100 + percent)
                    found = _tokens(grams, c, k, _spare_parts(_least_overlap(begins[c], percent), k), seed)
                    tokens.append(found)
                    rows += [at] * len(found)
            taken = batch.select(["v", "n", "rest", "label"]).take(pa.array(rows, pa.int64()))
            token = np.concatenate([np.empty(0, np.uint64), *tokens]).view(np.int64)
            yield pa.record_batch([pa.array(token), *taken.columns], schema=schema)

    sets = segments.join(members.select("v"), "v", "left_semi").groupBy("v").agg(F.flatten(F.collect_list("grams")).alias("grams"))
    return sets.join(members, "v").select("v", "n", "rest", "label", "grams").mapInArrow(deal, "token long, v binary, n long, rest long, label binary")


def _odd_pairs(placed: DataFrame, segments: DataFrame, percent: int) -> Iterator[DataFrame]:
    """Pairs (v, n, w, m) that are all of those of different labels that may be linked and meet in a bucket of ``placed(token, v, n, rest, label)``.

    Only vertices with another label than most of their bucket are compared
    with all of it. The members of buckets in which that makes more than
    MAX_PAIRS pairs are dealt anew, by ``_parts``: any two of them that are
    linked meet there, whichever bucket they met in before. So are those of
    large buckets of parts, by other hashes; what is still in a large bucket
    after _REDEALS times is compared in full.
    """
    for turn in range(_REDEALS + 1):
        by_label = placed.groupBy("token", "label").agg(F.count("*").alias("size"))
        mixed = by_label.groupBy("token").agg(F.max(F.struct("size", "label")).alias("top"), F.count("*").alias("labels"), F.sum("size").alias("all")).where("labels > 1")
        large = F.lit(False) if turn == _REDEALS else F.col("all") * (F.col("all") - F.col("top.size")) > MAX_PAIRS
        mixed = written(mixed.select("token", F.col("top.label").alias("main"), large.alias("large")), "join-mixed")
        small = mixed.where("NOT large").select("token", "main")
        odd = placed.join(small, "token").where("label <> main")
        met = odd.join(placed.select("token", *_other()), "token").where((F.col("label") != F.col("w_label")) & _may_link(percent))
        yield met.select("v", "n", "w", "m")
        if turn == _REDEALS or mixed.where("large").isEmpty():
            return
        members = written(placed.join(mixed.where("large").select("token"), "token", "left_semi").groupBy("v", "n", "label").agg(F.max("rest").alias("rest")), "join-members")
        placed = written(_parts(members, segments, percent, turn), "join-parts")


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs(doc_id, text)``.

    Words are lower-cased (A-Z); a document's set are its distinct n-grams, or
    its whole sequence if it has fewer than n words. Documents are linked when
    100 * |intersection| >= percent * |union|; component_id is the smallest
    doc_id reachable by links. The result is exact (sets are compared by 64-bit
    hashes of their n-grams).

    1. Blocks of documents learn how many documents each of their n-grams is in
       and the smallest id of each distinct set, by exchanging packed lists.
       Equal sets become one vertex.
    2. The global order of n-grams (rarest first) is cut into fragments by the
       power of two of that number. A vertex is a candidate only if enough of
       its set is in other documents; it sends its prefix (the places in which
       linked sets must meet) and a segment for each fragment.
    3. Vertices that meet in a prefix n-gram, early enough in both orders, are
       compared with the one that has least of its own before it (the least
       edited of a group of copies), whose links give first components; then
       with one that a hash chooses, if that is in another component. Then
       those in other components than most of their bucket are compared with
       all others there, so no link between components is missed
       and groups of thousands of copies are not expanded into pairs. The
       members of large buckets of several components are dealt anew, into
       buckets of equal parts of their sets. Partial overlaps are counted by
       fragment and summed for each pair.

    Null, empty and wordless texts have the empty set, linked with nothing.
    Rows without an id have no component (null) and no links. Repeated rows
    stay. An empty table gives an empty result. Further columns are ignored.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(_vertices(docs.where("doc_id IS NOT NULL"), n, percent), "join-vertices")
    prefix = rows.where("kind = 'prefix'").select("token", "v", "n", "rest")
    segments = rows.where("kind = 'segment'").select("v", "fragment", "grams")
    tried, links, labels = None, None, None
    for turn in range(_TURNS + 1):
        placed = prefix.withColumn("label", F.col("v")) if labels is None else prefix.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
        if turn < _TURNS:
            early = (F.col("n") - F.col("rest")) / F.col("n") if turn == 0 else F.lit(0.0)
            chosen = F.struct(early, F.xxhash64("v", F.pmod("token", F.lit(_ROTATIONS)))).alias("h")
            heads = placed.groupBy("token").agg(F.min(F.struct(chosen, *_other())).alias("head"), F.count("*").alias("met")).where("met > 1").select("token", "head.*").drop("h")
            rounds = [placed.join(heads, "token").where((F.col("label") != F.col("w_label")) & _may_link(percent))]
        else:
            rounds = _odd_pairs(written(placed, "join-placed"), segments, percent)
        for pairs in rounds:
            new = _ordered(pairs)
            new = written(new if tried is None else new.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "join-tried")
            found = written(_alike(new, segments, percent), "join-links")
            tried = new if tried is None else tried.unionByName(new)
            links = found if links is None else links.unionByName(found)
        if labels is None or turn == _TURNS or found.take(1):
            labels = components(links)
    doc = rows.where("kind = 'doc'").select("doc_id", "n", "rep", "v")
    first = F.conv(F.hex(F.substring("label", 1, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")
    named = doc.join(labels, "v", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(first.cast("long"), F.col("rep")).alias("component_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes = pa.array([len(s) for s in gram_sets(blocks.texts_of(batch), n)], pa.int64())
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.record_batch([none, sizes, none], names=["doc_id", "n_shingles", "component_id"])

    return named.unionAll(docs.where("doc_id IS NULL").select("text").mapInArrow(count, "doc_id long, n_shingles long, component_id long"))
