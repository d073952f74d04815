"""Token ids of documents as length-delimited binary records with a separate offset index.

A record file is a run of frames. A frame is

    u64 length | u32 masked checksum of those 8 bytes | payload | u32 masked checksum of the payload

little-endian; the checksum is CRC-32 (zlib's), masked as ((c >> 15 | c << 17)
+ 0xA282EAD8) mod 2**32, so that a checksum stored inside checked data is not
its own check. A payload is

    u8 flags (1: null doc_id; 2: ids of 4 bytes, else of 2) | i64 doc_id | u32 number of ids | ids

The index of ``x.rec`` is ``x.idx``: u64 offset of each frame in file order.
The manifest, a Parquet table, names the files that count, their order and the
number of documents and ids before each; files of lost attempts aren't in it.
"""

from __future__ import annotations

import json
import os
import random
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mediasieve.llm.batches import bound_batches, give_back, slices
from mediasieve.llm import store
from mediasieve.llm.words import piece_runs

#: Masking of checksums; fixed by the format.
MASK_DELTA = 0xA282EAD8
END_ID = 1
_HEAD, _META = struct.Struct("<QI"), struct.Struct("<BqI")
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
_WORD = "^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:;=-@\\[-`{-~]*)$"
#: The layout whose words are independent: white space separates, and letters, single digits and runs of other marks are apart.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload of the frame at an offset and the offset after it; ValueError if a checksum fails."""
    if len(data) < at + _HEAD.size:
        raise ValueError(f"frame at {at} is cut off")
    size, check = _HEAD.unpack_from(data, at)
    begin = at + _HEAD.size
    if masked(data[at : at + 8]) != check:
        raise ValueError(f"length at {at} fails its checksum")
    payload = data[begin : begin + size]
    if len(payload) != size or masked(payload) != int.from_bytes(data[begin + size : begin + size + 4], "little"):
        raise ValueError(f"payload at {at} fails its checksum")
    return payload, begin + size + 4


def serialize(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    return _META.pack((doc_id is None) + 2 * wide, doc_id or 0, len(ids)) + ids.astype("<u4" if wide else "<u2").tobytes()


def deserialize(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id, n = _META.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", n, _META.size).astype("<u4")
    return None if flags & 1 else doc_id, ids


def cuts_at_spaces(tokenizer) -> bool:
    """Whether words between ASCII white space are encoded independently, and runs of letters apart from the marks after them.

    That is so for the one layout of normaliser and splitter below; whole texts
    of any other tokenizer go to the library.
    """
    layout = json.loads(tokenizer.to_str())
    return (layout["normalizer"], layout["pre_tokenizer"]) == (_NORMALIZER, _SPLITTER) and not (layout["post_processor"] or layout["truncation"] or layout["padding"])


class WordEncoder:
    """Encodes whole texts with the tokenizers library, keeping the ids of words met before.

    Words between ASCII white space are looked up each for itself. Those of
    letters before ASCII marks (``_WORD``) are put together from the ids of the
    letters in lower case and of the marks, which the splitter keeps apart and
    neither composition nor lower-casing can join: only such letters count as
    are composed, have one lower-case letter and are below U+0100; an
    apostrophe (contractions) and ``<`` (special tokens) are no such marks. All
    other words go to the library as they are, and so do whole texts of a
    tokenizer that may treat words otherwise (``cuts_at_spaces``).

    What is kept takes about ``cache_bytes``: two generations, of which the
    older is dropped when the younger is full.
    """

    def __init__(self, path: str | None, cache_bytes: int = 96 << 20):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = cuts_at_spaces(self.tokenizer)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.room, self.used = cache_bytes // 2, 0
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def forget(self) -> None:
        """Drops the words met before."""
        self.young, self.old, self.used = {}, {}, 0

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text.encode()]))

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of strings. Runs of letters are encoded many to a text: the last token of each ends a word."""
        letters = [w for w in new if _LETTERS.fullmatch(w)]
        groups = [letters[i : i + 64] for i in range(0, len(letters), 64)]
        found = {}
        for group, ids in zip(groups, self._ids([" ".join(g) for g in groups])):
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(group):
                data, edges = ids.tobytes(), [0, *(4 * ends).tolist()]
                found.update(zip(group, (data[a:b] for a, b in zip(edges, edges[1:]))))
        rest = [w for w in new if w not in found]
        found.update(zip(rest, (i.tobytes() for i in self._ids(rest))))
        return found

    def _known(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct strings one after another, and the number of each."""
        if self.used > self.room:
            self.old, self.young, self.used = self.young, {}, 0
        coded = list(map(self.young.get, strings))
        left = [k for k, ids in enumerate(coded) if ids is None]
        older = {w: ids for k in left if (ids := self.old.get(w := strings[k])) is not None}
        older |= self._learn([strings[k] for k in left if strings[k] not in older])
        for k in left:
            coded[k] = older[strings[k]]
            if self.used <= self.room:  # what finds no room is encoded again when it is met again
                self.young[strings[k]] = coded[k]
                self.used += len(strings[k]) + len(coded[k]) + 200  # about what both objects and their entry take
        return np.frombuffer(b"".join(coded), "<u4"), np.array([len(i) // 4 for i in coded], np.int64)

    def encode_all(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text, which are met in runs of about 1 MB; longer texts are cut between words."""
        if not self.by_word:
            for k in range(0, len(texts), 64):
                yield from self._ids([t.decode() for t in texts[k : k + 64]])
            return
        held: list[np.ndarray] = []  # of a text that goes on
        for pieces, last in piece_runs(texts, 1 << 20):
            split = pc.ascii_split_whitespace(pa.array(pieces, pa.large_binary()).cast(pa.large_string()))
            coded = split.flatten().dictionary_encode()
            parts = pc.extract_regex(coded.dictionary, _WORD)
            fits = parts.is_valid()
            word = pc.if_else(fits, pc.utf8_lower(parts.field("letters")), coded.dictionary).dictionary_encode()
            mark = pc.if_else(fits, parts.field("marks"), "").dictionary_encode()
            flat, size = self._known(word.dictionary.to_pylist() + mark.dictionary.to_pylist())
            both = np.stack([word.indices.to_numpy(), mark.indices.to_numpy() + len(word.dictionary)], axis=1).ravel()
            flat, size = _gather(flat, size, both), size[both].reshape(-1, 2).sum(axis=1)
            place = coded.indices.to_numpy()
            out, ends = _gather(flat, size, place), np.concatenate([[0], np.cumsum(size[place])])
            edges = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
            for part, done in zip(np.split(out, edges[1:-1]), last):
                held.append(part)
                if done:
                    yield held[0] if len(held) == 1 else np.concatenate(held)
                    held = []


def _gather(flat: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The runs of ``flat``, of these sizes, at these places in the order given."""
    begin, mine = (np.cumsum(size) - size)[place], size[place]
    ends = np.cumsum(mine)
    return flat[np.repeat(begin - ends + mine, mine) + np.arange(ends[-1] if len(ends) else 0)]


_ENCODERS: dict[str | None, WordEncoder] = {}


def encoder_of(path: str | None) -> WordEncoder:
    """The encoder of this worker process; later tasks go on with its tokenizer."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_records(docs: DataFrame, where: str, tokenizer_path: str | None = None, end_id: int = END_ID, n_files: int | None = None) -> DataFrame:
    """Writes the ids of every whole text of ``docs(doc_id, text)`` under the folder ``where``; returns the manifest.

    Documents lie in ascending doc_id order over the files in manifest order
    (null ids first, ties by a hash of the text); each is followed by
    ``end_id``. One file for each range partition of doc_id (``n_files``; the
    session's shuffle partitions unless given). A task writes to a name of its
    own, so repeated and lost tasks leave files that no manifest names.

    Null text counts as empty and has the end id alone. Repeated rows are
    records of their own. An empty table gives an empty manifest. Further
    columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    n_files = n_files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # The hash splits and orders rows that share an id.
    keyed = rows.withColumn("tie", F.xxhash64("text"))
    dealt = keyed.repartitionByRange(n_files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name, encoder, end = f"{where}/part-{part:06d}-{uuid.uuid4().hex}", encoder_of(tokenizer_path), np.array([end_id], "<u4")
        out, at, offsets, n_ids = None, 0, [], 0
        for batch in slices(batches, 512):
            out = out or store.create(name + ".rec")
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode_all(batch.column("text").cast(pa.large_binary()).to_pylist())):
                data = frame(serialize(doc_id, np.concatenate([ids, end])))
                offsets.append(at)
                n_ids += len(ids) + 1
                at += len(data)
                out.write(data)
        encoder.forget()
        give_back()
        if out is not None:
            out.close()
            with store.create(name + ".idx") as index:
                index.write(np.array(offsets, "<u8").tobytes())
            yield pa.RecordBatch.from_pylist([{"part": part, "file": name, "n_docs": len(offsets), "n_ids": n_ids, "n_bytes": at}])

    dealt.mapInArrow(write, "part long, file string, n_docs long, n_ids long, n_bytes long").write.parquet(f"{where}/manifest-files")
    # One row for each file: prefix sums over them fit one task.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    files = spark.read.parquet(f"{where}/manifest-files")
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(name) for c, name in (("n_docs", "docs_before"), ("n_ids", "ids_before"))]
    files.select("part", "file", "n_docs", "n_ids", "n_bytes", *sums).write.parquet(f"{where}/manifest")
    return spark.read.parquet(f"{where}/manifest")


def read_records(spark: SparkSession, where: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file, position) of every record of the files in the manifest.

    ``start`` counts the ids of all records before it; every frame's checksums
    and the index are verified. Files are read by tasks of their own, frame by
    frame.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start = row["ids_before"]
                with store.open_file(row["file"] + ".idx") as f:
                    offsets = np.frombuffer(f.read(), "<u8")
                if len(offsets) != row["n_docs"]:
                    raise ValueError(f"the index of {row['file']} has {len(offsets)} records; the manifest has {row['n_docs']}")
                ends = np.append(offsets[1:], row["n_bytes"])
                with store.open_file(row["file"] + ".rec") as f:
                    for k in range(0, len(offsets), 1024):
                        found = []
                        for i, (a, b) in enumerate(zip(offsets[k : k + 1024].tolist(), ends[k : k + 1024].tolist()), k):
                            doc_id, ids = deserialize(unframe(f.read(b - a))[0])
                            found.append({"doc_id": doc_id, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes()), "file": row["file"], "position": i})
                            start += len(ids)
                        yield pa.RecordBatch.from_pylist(found, pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("file", pa.string()), ("position", pa.int64())]))

    manifest = spark.read.parquet(f"{where}/manifest")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = manifest.repartition(parts, "part")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, position long")


def read_shuffled(spark: SparkSession, where: str, seed: int, buffer: int = 1024) -> DataFrame:
    """(doc_id, ids) of all records in a shuffled order: files by hash, records of a file by its index.

    The index gives any record by one seek, so an epoch needs no pass over the
    data to shuffle it; ``buffer`` is the number of records in an Arrow batch.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_file(row["file"] + ".idx") as f:
                    offsets = np.frombuffer(f.read(), "<u8").tolist()
                order = list(range(len(offsets)))
                random.Random(f"{seed}:{row['part']}").shuffle(order)
                with store.open_file(row["file"] + ".rec") as f:
                    for k in range(0, len(order), buffer):
                        found = []
                        for i in order[k : k + buffer]:
                            f.seek(offsets[i])
                            end = offsets[i + 1] if i + 1 < len(offsets) else row["n_bytes"]
                            doc_id, ids = deserialize(unframe(f.read(end - offsets[i]))[0])
                            found.append({"doc_id": doc_id, "ids": ids.tolist()})
                        yield pa.RecordBatch.from_pylist(found, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    manifest = spark.read.parquet(f"{where}/manifest")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = manifest.repartition(parts, F.xxhash64("part", F.lit(seed))).sortWithinPartitions(F.xxhash64("part", F.lit(seed)))
    return ordered.mapInArrow(read, "doc_id long, ids array<int>")
