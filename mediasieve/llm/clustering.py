"""Centroid clustering of vectors in exact integers: matrix products in double precision, sums combined over an RDD tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasieve.llm.batches import bound_batches
from mediasieve.llm.scratch import written

#: Vectors of a block.
BLOCK_ROWS = 4096
#: Doubles hold all integers below this, 64-bit integers those below the other.
_DOUBLE, _LONG = 1 << 53, 1 << 63
_TYPES = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}


def whole_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id, x): vectors of ``dim`` components, none of them null, NaN or infinite."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == dim) & finite)


def _integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): 64-bit where that holds them all, else Python's integers."""
    if not x.size or np.abs(x).max() < 2.0**62 / scale:
        return np.floor(x * scale).astype(np.int64)
    flat = [int(np.floor(e * scale)) if abs(e) < 2.0**53 else scale * int(e) for e in x.ravel().tolist()]
    return np.array(flat, object).reshape(x.shape)


def _pack(x: np.ndarray) -> tuple[int, bytes]:
    """Width in bytes (0: decimal text) and the components."""
    if x.dtype == object:
        return 0, ",".join(map(str, x.ravel())).encode()
    most = int(np.abs(x).max()) if x.size else 0
    wide = next(w for w in _TYPES if most < 1 << (8 * w - 1))
    return wide, x.astype(_TYPES[wide]).tobytes()


def _unpack(wide: int, data: bytes, dim: int) -> np.ndarray:
    if wide:
        return np.frombuffer(data, _TYPES[wide]).reshape(-1, dim).astype(np.int64)
    return np.array([int(e) for e in data.decode().split(",")], object).reshape(-1, dim)


def integer_blocks(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """(ids, wide, components): blocks of up to BLOCK_ROWS integer vectors, in as few bytes as each block's largest component takes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(k, BLOCK_ROWS)
                wide, data = _pack(_integers(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale))
                yield pa.RecordBatch.from_pydict({"ids": pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), "wide": pa.array([wide], pa.int32()), "components": pa.array([data], pa.binary())})

    bound_batches(vectors.sparkSession)
    return whole_vectors(vectors, dim).mapInArrow(pack, "ids array<bigint>, wide int, components binary")


def _most(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each integer vector (the smallest of equals) and the squared distance to it.

    |x|^2 - 2 x.c + |c|^2 by matrix product. ``bound`` is the sum of the
    absolute values of all terms: below 2^53 every intermediate result of the
    product in doubles is an exact integer, whatever the order of its sums.
    Above it 64-bit integers do the same, above 2^63 Python's.
    """
    m, c = _most(x), _most(centroids)
    bound = x.shape[1] * (m + c) ** 2
    kind = np.float64 if bound < _DOUBLE else np.int64 if bound < _LONG else object
    a, b = x.astype(kind), centroids.astype(kind)
    distances = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
    cluster = np.argmin(distances, axis=1).astype(np.int64) if len(x) else np.empty(0, np.int64)
    found = distances[np.arange(len(x)), cluster]
    return cluster, found.astype(np.int64) if kind is np.float64 else found


def _sums(x: np.ndarray, cluster: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Component sums of each cluster as Python's integers, and its number of vectors."""
    member = cluster[None, :] == np.arange(k)[:, None]
    bound = _most(x) * len(x)
    kind = np.float64 if bound < _DOUBLE else np.int64 if bound < _LONG else object
    total = member.astype(kind) @ x.astype(kind)
    total = total.astype(np.int64) if kind is np.float64 else total
    return total.astype(object), member.sum(axis=1).astype(object)


def _round(blocks: DataFrame, centroids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums, numbers of vectors and summed distances of the clusters: k * (dim + 2) integers, combined over a tree of tasks."""
    k, dim = centroids.shape

    def add(state, block):
        x = _unpack(block[0], bytes(block[1]), dim)
        cluster, distance = nearest(x, centroids)
        total, count = _sums(x, cluster, k)
        far = _sums(distance[:, None], cluster, k)[0][:, 0]
        return merge(state, (total, count, far))

    def merge(a, b):
        return b if a is None else a if b is None else tuple(p + q for p, q in zip(a, b))

    found = blocks.select("wide", "components").rdd.treeAggregate(None, add, merge, depth)
    nothing = np.zeros((k, dim), object), np.zeros(k, object), np.zeros(k, object)
    return nothing if found is None else found


def _start(vectors: DataFrame, dim: int, scale: int, k: int, seed: int) -> np.ndarray:
    """The first k vectors by hash of their id; rows that share an id come in order of their components."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = whole_vectors(vectors, dim).select(name.alias("name"), "x").orderBy("name", "x").limit(k).collect()
    return _integers(np.array([r.x for r in first], np.float64).reshape(-1, dim), scale)


def _long(values: np.ndarray) -> list[int | None]:
    """Integers as they are, None for those that 64 bits don't hold."""
    return [int(v) if v < _LONG else None for v in values.tolist()]


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, depth: int = 2) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of ``vectors(vec_id, embedding)``.

    Components become floor(scale * x). The first k vectors by sha256 of
    ``seed:vec_id`` are the first centroids; each round assigns every vector to
    the nearest and moves non-empty centroids to the floor of their vectors'
    mean; then vectors are assigned once more. All of it is exact, so the
    result depends neither on partitions nor on the order of sums, and a task
    that runs again adds the same integers.

    The driver holds k * (dim + 2) integers, never vectors (but the k first).
    Blocks are written once to the shared folder and read by each round.

    Vectors of another length, or with a null or non-finite component, are left
    out. Rows that repeat an id or a vector count each for itself; a null id
    hashes as an empty one. With fewer than k vectors each is a centroid; an
    empty table gives no rows. A distance or sum over 2^63 - 1 is null, though
    it is compared exactly. Further columns are ignored.
    """
    spark = vectors.sparkSession
    blocks = written(integer_blocks(vectors, dim, scale), "vector-blocks")
    centroids = _start(vectors, dim, scale, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        sums, counts, _inertia = _round(blocks, centroids, depth)
        moved = [[s // n for s in row] if n else list(old) for row, n, old in zip(sums.tolist(), counts.tolist(), centroids.tolist())]
        centroids = np.array(moved, object)
        centroids = centroids.astype(np.int64) if _most(centroids) < _LONG else centroids
    far = _round(blocks, centroids, depth)[2] if len(centroids) else np.zeros(0, object)
    each, everything = _long(far), _long(np.array([sum(far.tolist())], object))[0]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, wide, data in zip(*(batch.column(j) for j in range(3))):
                cluster, distance = nearest(_unpack(wide.as_py(), data.as_py(), dim), centroids)
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": ids.values,
                        "cluster": pa.array(cluster, pa.int32()),
                        "distance": pa.array(_long(distance), pa.int64()),
                        "cluster_inertia": pa.array(each, pa.int64()).take(pa.array(cluster)),
                        "inertia": pa.array([everything] * len(cluster), pa.int64()),
                        "centroid_sha256": pa.array(names, pa.string()).take(pa.array(cluster)),
                    }
                )

    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return blocks.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
