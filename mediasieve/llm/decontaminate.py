"""Benchmark decontamination: q-gram lemma filter over diagonal bands, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasieve.llm import store
from mediasieve.llm.batches import bound_batches, slices
from mediasieve.llm.scratch import scratch_dir

Q = 8
_TABLE_BITS = 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20
#: Shared q-grams that are held at a time, but for texts too short to be cut.
_MAX_HITS = 1 << 21
#: Repetitions of up to so many bytes are shortened where they make many hits.
_MAX_PERIOD = 64
#: A-Z become a-z and the bytes 0x09-0x0D spaces; places stay the same.
_FOLD = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_MATCHES = "item_id long, start long, end long, edits long, n_windows long"


def fold(text: str | bytes | None) -> bytes:
    data = text.encode() if isinstance(text, str) else text or b""
    return data.translate(_FOLD)


def q_grams(folded: bytes, q: int = Q) -> np.ndarray:
    """The q-gram at each byte as a 64-bit integer; q is a power of two up to 8."""
    a, width = np.frombuffer(folded, np.uint8).astype(np.uint64), 1
    while width < q:
        a = a[:-width] | a[width:] << np.uint64(8 * width) if len(a) > width else a[:0]
        width *= 2
    return a


@dataclass
class Pattern:
    item_id: int | None
    text: bytes
    budget: int  # edits at most

    @property
    def q(self) -> int:
        """The longest q-grams of which a text within the budget keeps one at least."""
        return next(q for q in (Q, 4, 2, 1) if q * (self.budget + 1) <= len(self.text) or q == 1)

    @property
    def least(self) -> int:
        """q-gram lemma: a text within the budget keeps so many of the pattern's q-grams."""
        return len(self.text) + 1 - self.q - self.budget * self.q


def patterns_of(items: list[tuple[int | None, str | None]], max_error: float, window: int) -> list[Pattern]:
    """Windows of ``window`` bytes of each item, half overlapping, or the whole of a shorter one.

    The edit budget is ``max_error`` of the length, less than all of it. Items
    without a byte that isn't white space have no pattern.
    """
    found = []
    for item_id, text in items:
        folded = fold(text).strip()
        starts = sorted({*range(0, max(1, len(folded) - window), window // 2), max(0, len(folded) - window)})
        for a in starts:
            if piece := folded[a : a + window]:
                found.append(Pattern(item_id, piece, min(int(max_error * len(piece)), len(piece) - 1)))
    return found


def align(pattern: bytes, budget: int, regions: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each region the fewest edits in its band, and where such a part of it begins and first ends.

    A region is a number of bytes that are missing before it, and bytes from
    the band's first diagonal on; only the band's 2 * (budget + 1) diagonals
    are filled. Missing bytes match nothing.
    """
    wide, m = 2 * (budget + 1), len(pattern)
    table = np.full((len(regions), wide + m), -1, np.int16)
    for k, (pad, r) in enumerate(regions):
        table[k, pad : pad + len(r)] = np.frombuffer(r, np.uint8)
    edit = 1 << wide.bit_length()  # a cell holds its edits, and in lower bits how far from the band's end it began
    ramp = np.arange(wide, dtype=np.int64)
    row = np.broadcast_to(wide - 1 - ramp, (len(regions), wide)).copy()
    for i, c in enumerate(pattern):
        new = row + edit * (table[:, i : i + wide] != c)
        np.minimum(new[:, :-1], row[:, 1:] + edit, out=new[:, :-1])
        row = np.minimum.accumulate(new - edit * ramp, axis=1) + edit * ramp
    edits = row // edit
    best = edits.argmin(axis=1)
    at = np.arange(len(regions))
    pad, size = (np.array(x, np.int64) for x in zip(*((pad, len(r)) for pad, r in regions)))
    start = wide - 1 - row[at, best] % edit - pad
    return edits[at, best], np.clip(start, 0, size), np.clip(m + best - pad, 0, size)


def shorten(folded: bytes, room: int) -> tuple[bytes, np.ndarray]:
    """A text with the middle of each long repetition left out, and the places of the bytes that stay.

    A repetition of up to _MAX_PERIOD bytes keeps ``room`` bytes or more, in
    whole periods, so the text has the same parts of up to room / 2 bytes.
    """
    a, place = np.frombuffer(folded, np.uint8), np.arange(len(folded))
    for p in range(1, _MAX_PERIOD + 1):
        if len(a) <= room + p:
            break
        edges = np.flatnonzero(np.diff(a[p:] == a[:-p], prepend=False, append=False))
        begin, size = edges[::2], np.diff(edges)[::2]
        long = size > room + p
        if long.any():
            keep = np.ones(len(a), bool)
            for b, n in zip(begin[long].tolist(), size[long].tolist()):
                keep[b + room // 2 : b + room // 2 + (n - room) // p * p] = False
            a, place = a[keep], place[keep]
    return a.tobytes(), place


class _Index:
    """The q-grams of distinct patterns of the same q."""

    def __init__(self, patterns: list[tuple[Pattern, list[int | None]]], q: int):
        self.q, self.patterns, self.items = q, [p for p, _ in patterns], [i for _, i in patterns]
        grams = [q_grams(p.text, q) for p in self.patterns]
        keys = np.concatenate(grams)
        owner = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams])
        order = np.argsort(keys, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.keys, begin = np.unique(keys[order], return_index=True)
        self.begin = np.append(begin, len(keys))
        self.seen = np.zeros(1 << _TABLE_BITS, bool)
        self.seen[self._slot(self.keys)] = True
        self.step = np.array([p.budget + 1 for p in self.patterns])
        self.least = np.array([p.least for p in self.patterns])
        self.longest = max(len(p.text) for p in self.patterns)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * _SPREAD >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def _shared(self, folded: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places of the text's q-grams that a pattern has, and the places of those among the keys."""
        grams = q_grams(folded, self.q)
        at = np.flatnonzero(self.seen[self._slot(grams)])
        found = np.searchsorted(self.keys, grams[at])
        found[found == len(self.keys)] = 0
        same = self.keys[found] == grams[at]
        return at[same], found[same]

    def _by_hits(self, found: np.ndarray) -> Iterator[_Index]:
        """The index, or where a text's q-grams have too many hits in it, parts of it by patterns that have _MAX_HITS or one pattern each."""
        often = np.bincount(found, minlength=len(self.keys))
        hits = np.bincount(self.owner, np.repeat(often, np.diff(self.begin)), len(self.patterns))
        if hits.sum() <= _MAX_HITS:
            yield self
            return
        part_of = (np.cumsum(hits) // _MAX_HITS).astype(np.int64)
        key = np.repeat(np.arange(len(self.keys)), np.diff(self.begin))
        for part in np.unique(part_of[hits > 0]):
            mine = part_of[self.owner] == part
            some = copy(self)
            some.owner, some.place = self.owner[mine], self.place[mine]
            some.begin = np.concatenate([[0], np.cumsum(np.bincount(key[mine], minlength=len(self.keys)))])
            yield some

    def bands(self, n: int, at: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, band) with as many distinct shared q-grams as the lemma asks for, in a text of n bytes.

        Band b of a pattern with budget k holds the diagonals from b * (k + 1)
        to (b + 2) * (k + 1) - 1, so each run of k + 1 diagonals lies in one.
        """
        size = self.begin[found + 1] - self.begin[found]
        ends = np.cumsum(size)
        index = np.repeat(self.begin[found] - ends + size, size) + np.arange(int(size.sum()))
        owner, place = self.owner[index].astype(np.int64), self.place[index].astype(np.int64)
        strip = (np.repeat(at, size) - place + self.longest) // self.step[owner]
        # Cheap first look: strips and their neighbours counted in a hashed table that can only count too many.
        n_strips = n + 2 * self.longest + 2
        slot = (owner * n_strips + strip) & ((1 << _TABLE_BITS) - 1)
        count = np.bincount(slot, minlength=1 << _TABLE_BITS)
        ring = lambda d: count[(slot + d) & ((1 << _TABLE_BITS) - 1)]
        enough = count[slot] + np.maximum(ring(1), ring(-1)) >= self.least[owner]
        owner, place, strip = owner[enough], place[enough], strip[enough]
        band = np.concatenate([strip, strip - 1])
        key = (np.concatenate([owner, owner]) * n_strips + np.maximum(band, 0)) * self.longest + np.concatenate([place, place])
        key, size = np.unique(np.unique(key) // self.longest, return_counts=True)
        owner, band = key // n_strips, key % n_strips
        enough = size >= self.least[owner]
        return owner[enough], band[enough]

    def find(self, pieces: list[tuple[int, bytes, np.ndarray | int]], found: list[dict], short: bool = False) -> None:
        """Adds what is in pieces (text, folded bytes, and the place of each byte or of the first).

        Where patterns repeat themselves as the text does, every place meets
        many: such repetitions are shortened, and what still has too many hits
        is cut into halves that overlap by more than a match can be long.
        """
        joined = (b"\0" * self.q).join(f for _, f, _ in pieces)
        at, keys = self._shared(joined)
        hits, lap = int((self.begin[keys + 1] - self.begin[keys]).sum()), 2 * self.longest
        if hits > 4 * len(joined) + (1 << 16) and not short:
            less = []
            for d, f, place in pieces:
                f, kept = shorten(f, 2 * lap)
                less.append((d, f, kept + place if isinstance(place, int) else place[kept]))
            return self.find(less, found, True)
        if hits > _MAX_HITS and len(pieces) > 1:
            for half in (pieces[: len(pieces) // 2], pieces[len(pieces) // 2 :]):
                self.find(half, found, short)
            return None
        if hits > _MAX_HITS and len(pieces[0][1]) > 4 * lap:
            d, f, place = pieces[0]
            cut = len(f) // 2
            for a, b in ((0, cut + lap), (cut, len(f))):
                self.find([(d, f[a:b], place + a if isinstance(place, int) else place[a:b])], found, short)
            return None
        owners, bands = (np.concatenate(x) for x in zip(*(part.bands(len(joined), at, keys) for part in self._by_hits(keys))))
        starts = np.cumsum([0] + [len(f) + self.q for _, f, _ in pieces])
        for o in np.unique(owners):
            self._verify(int(o), bands[owners == o], pieces, starts, found)
        return None

    def _verify(self, o: int, bands: np.ndarray, pieces: list, starts: np.ndarray, found: list[dict]) -> None:
        p = self.patterns[o]
        regions: dict[tuple[int, int], tuple[int, bytes]] = {}
        for low in (bands * self.step[o] - self.longest).tolist():
            high = low + 2 * (p.budget + 1) + len(p.text)
            for d in range(max(0, int(np.searchsorted(starts, low, "right")) - 1), len(pieces)):
                if starts[d] >= high:
                    break
                begin, text = low - int(starts[d]), pieces[d][1]
                a, b = max(0, begin), min(len(text), high - int(starts[d]))
                if b - a >= len(p.text) - p.budget:
                    regions[d, a] = a - begin, text[a:b]
        # Equal regions are aligned once.
        spans: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        rest = []
        for r in set(regions.values()):
            exact = r[1].find(p.text)
            if exact >= 0:
                spans[r] = exact, exact + len(p.text), 0
            else:
                rest.append(r)
        for i in range(0, len(rest), 1024):
            some = rest[i : i + 1024]
            edits, start, end = (x.tolist() for x in align(p.text, p.budget, some))
            spans |= {r: (a, b, e) for r, a, b, e in zip(some, start, end, edits) if e <= p.budget}
        for (d, a), r in regions.items():
            if r not in spans:
                continue
            start, end, edits = spans[r]
            doc, _, place = pieces[d]
            start, end = (x + place if isinstance(place, int) else int(place[x - k]) + k for x, k in ((a + start, 0), (a + end, 1)))
            for item in self.items[o]:
                old = found[doc].get(item, (start, end, edits, set()))
                found[doc][item] = (min(old[0], start), max(old[1], end), min(old[2], edits), old[3] | {p.text})


class Matcher:
    """Finds patterns in texts; built once in each task from a bounded set of patterns. Equal patterns of several items are looked for once."""

    def __init__(self, patterns: list[Pattern]):
        groups: dict[int, dict[bytes, tuple[Pattern, list[int | None]]]] = {}
        for p in patterns:
            items = groups.setdefault(p.q, {}).setdefault(p.text, (p, []))[1]
            if p.item_id not in items:
                items.append(p.item_id)
        self.indexes = [_Index(list(group.values()), q) for q, group in groups.items()]

    def matches(self, texts: list[bytes]) -> list[dict[int | None, tuple[int, int, int, set[bytes]]]]:
        """For each text, by item: start and end in bytes, fewest edits of a window, windows found."""
        found: list[dict] = [{} for _ in texts]
        for index in self.indexes:
            # Longer texts are cut into pieces that overlap by more than a match can be long.
            lap, run, size = 2 * index.longest, [], 0
            for d, t in enumerate(texts):
                for a in range(0, max(1, len(t)), _CHUNK):
                    piece = fold(t[a : a + _CHUNK + lap])
                    if run and size + len(piece) > _CHUNK:
                        index.find(run, found)
                        run, size = [], 0
                    run.append((d, piece, a))
                    size += len(piece) + index.q
            if run:
                index.find(run, found)
        return found


Items = list[tuple[int | None, str | None]]


def _blocks(benchmark: DataFrame, max_block_bytes: int) -> list[Callable[[], Items]]:
    """The benchmark in blocks of about a size, by hash, each as a function that gives a task its items.

    One block goes along with the function. More are written to the shared
    folder, from which each task reads the block that it searches for, so the
    driver never holds the benchmark.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-n_bytes // max_block_bytes) or 1
    if n == 1:
        held = sorted(((r.item_id, r.text) for r in items.collect()), key=repr)
        return [lambda: held] if held else []
    where = scratch_dir(benchmark.sparkSession, "benchmark")
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    items.withColumn("block", block).repartition(n, "block").write.partitionBy("block").parquet(where)

    def block_reader(k: int) -> Callable[[], Items]:
        def read() -> Items:
            found = []
            for name in store.names(f"{where}/block={k}", ".parquet"):
                with store.open_file(name) as f:
                    table = pq.read_table(f)
                found += zip(table.column("item_id").to_pylist(), table.column("text").to_pylist())
            return sorted(found, key=repr)

        return read

    return [block_reader(k) for k in range(n)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_error: float = 0.1, window: int = 96, max_block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, item_id, start, end, edits, n_windows): the items of ``benchmark(item_id, text)`` in each whole text of ``docs(doc_id, text)``.

    An item is found if the text has a part within ``max_error`` edits a
    character (A-Z and a-z alike, white space alike) of one of its windows of
    ``window`` bytes, or of the whole item if it is shorter. Candidates are
    diagonal bands with as many shared q-grams as the q-gram lemma asks for
    (of 8 bytes; of fewer for items so short that the lemma needs that);
    an alignment inside the band confirms them, so nothing within the budget is
    missed. Start and end, in code points, span all windows found; ``edits`` is
    the smallest of theirs; ``n_windows`` counts different windows.

    The benchmark is the query set: it goes to the tasks in blocks of about
    ``max_block_bytes``, one pass over the documents for each; documents aren't
    shuffled. Null and empty texts and items match nothing. Repeated rows give
    repeated results; empty tables give none; further columns are ignored.
    """
    out = None
    bound_batches(docs.sparkSession)
    for items in _blocks(benchmark, max_block_bytes):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(patterns_of(items(), max_error, window))
            for batch in slices(batches):
                texts = [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
                rows = []
                for doc_id, t, found in zip(batch.column("doc_id").to_pylist(), texts, matcher.matches(texts)):
                    for item_id, (a, b, edits, windows) in found.items():
                        a, b = (len(t[:x].decode("utf-8", "ignore")) for x in (a, b))
                        rows.append({"doc_id": doc_id, "item_id": item_id, "start": a, "end": b, "edits": edits, "n_windows": len(windows)})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "start", "end", "edits", "n_windows")]))

        some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {_MATCHES}")
        out = some if out is None else out.unionAll(some)
    return docs.sparkSession.createDataFrame([], f"doc_id long, {_MATCHES}") if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, max_error: float = 0.1, window: int = 96, max_block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs`` whose text has none of the benchmark's items as ``find_leaks`` finds them; all columns stay.

    With one block of the benchmark rows are filtered where they are. With more,
    each pass gives digests of the texts with a leak, and rows of such texts go.
    """
    bound_batches(docs.sparkSession)
    blocks = _blocks(benchmark, max_block_bytes)
    if not blocks:
        return docs

    def leaks(batch: pa.RecordBatch, matcher: Matcher) -> list[bool]:
        return [bool(f) for f in matcher.matches([t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()])]

    if len(blocks) == 1:

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(patterns_of(blocks[0](), max_error, window))
            for batch in slices(batches):
                yield batch.filter(pa.array([not x for x in leaks(batch, matcher)], pa.bool_()))

        return docs.mapInArrow(keep, docs.schema)
    gone = None
    for items in blocks:

        def digests(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(patterns_of(items(), max_error, window))
            for batch in slices(batches):
                yield batch.select(["digest"]).filter(pa.array(leaks(batch, matcher), pa.bool_()))

        some = docs.select("text", F.sha2("text", 256).alias("digest")).mapInArrow(digests, "digest string")
        gone = some if gone is None else gone.unionAll(some)
    leaked = gone.distinct().withColumnRenamed("digest", "_leaked")
    return docs.join(leaked, F.sha2(docs["text"], 256) == leaked["_leaked"], "left_anti")
