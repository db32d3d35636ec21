"""Centroid clustering of whole-number vectors by a bisector tournament.

Vectors are turned into integers, ``floor(scale * x)`` per component. The first centroids are the vectors
with the smallest SHA-256 of their id. A round gives every vector to its nearest
centroid and replaces each centroid that has vectors by their floored mean.

Nearest centroid: the points as near to ``ci`` as to ``cj`` are a plane with normal ``2 (cj - ci)`` and
threshold ``|cj|^2 - |ci|^2``, both whole numbers worked out once a round for every pair. A vector meets the
centroids in the order of their numbers: the sign of one linear test says whether the holder or the newcomer
is nearer, and zero keeps the holder, which has the smaller number. ``k - 1`` tests leave the nearest
centroid; only its distance is worked out. All arithmetic is exact.

Scale: a round is one scan. Each task sums its vectors by centroid and sends ``k`` rows, which are added up by
component on the executors, so a centroid that holds a third of all vectors is no hot key. Only centroids
(``k * dims`` numbers) go through the driver and to the tasks. Vectors are written once as integers
to the shared folder, so a lost executor costs its tasks of the round alone.

Defined results: a vector that is null, has a null or non-finite component or another number of components
than ``dims`` is left out; repeated rows and ids are vectors of their own, each with its result; rows with a null
id are clustered but never start a centroid; where vectors share an id their components break the tie;
fewer vectors than ``k`` give as many centroids; an empty table gives an empty table. Only the id and the
vector are read, so other columns, whatever their names, do not matter. Components so
large that a squared distance could pass 64 bits end the job with a message.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.tables import shared
from wordloom.llm.vectors import whole_vectors

K, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, "1:"
#: Vectors worked on at a time in a task.
SLICE = 4096


def largest_component(dims: int) -> int:
    """Largest size of a component for which all distances and tests fit in 64 bits."""
    return 1 << ((60 - max(1, dims - 1).bit_length()) // 2)


def integers(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE
) -> DataFrame:
    """``vec_id``, ``v``: the usable vectors as little-endian 32-bit integers."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    limit = largest_component(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, _, whole = whole_vectors(batch.column(1), scale, limit, dims)
            packed = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(4 * dims), len(good), [None, pa.py_buffer(whole.astype("<i4").tobytes())])
            ids = batch.column(0).take(pa.array(good))
            yield pa.RecordBatch.from_arrays([ids, packed.cast(pa.binary())], names=["vec_id", "v"])

    return rows.mapInArrow(run, T.StructType([rows.schema["vec_id"], T.StructField("v", T.BinaryType())]))


def first_centroids(ints: DataFrame, k: int = K, seed: str = SEED) -> np.ndarray:
    """The vectors of the ``k`` smallest hashes of their ids, in the order of the hashes."""
    hashed = ints.where("vec_id is not null").select(
        F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    taken = hashed.orderBy("h", "v").limit(k).collect()
    dims = len(taken[0]["v"]) // 4 if taken else 0
    return np.array([np.frombuffer(r["v"], "<i4") for r in taken], np.int64).reshape(len(taken), dims)


def bisectors(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normals and thresholds: ``v . normal[i, j] > threshold[i, j]`` if ``v`` is nearer to ``j`` than to ``i``."""
    square = (centroids * centroids).sum(axis=1)
    return 2 * (centroids[None, :, :] - centroids[:, None, :]), square[None, :] - square[:, None]


def tournament(v: np.ndarray, normals: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of each vector, the smaller number of equals."""
    holder = np.zeros(len(v), np.int64)
    for j in range(1, len(thresholds)):
        side = np.einsum("nd,nd->n", v, normals[holder, j]) - thresholds[holder, j]
        holder[side > 0] = j
    return holder


def _slices(column: pa.Array, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, len(column), SLICE):
        part = b"".join(column.slice(at, SLICE).to_pylist())
        yield at, np.frombuffer(part, "<i4").astype(np.int64).reshape(-1, dims)


def moved(ints: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floored means of what is nearest, or themselves if nothing is."""
    k, dims = centroids.shape
    normals, thresholds = bisectors(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, v in _slices(batch.column(0), dims):
                nearest = tournament(v, normals, thresholds)
                counts += np.bincount(nearest, minlength=k)
                for c in np.unique(nearest):
                    sums[c] += v[nearest == c].sum(axis=0)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.astype(np.int32)), pa.array(counts[held]),
             pa.array(list(sums[held]), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"])

    parts = ints.select("v").mapInArrow(run, "cluster int, n long, sums array<long>")
    total = parts.select("cluster", "n", F.posexplode("sums").alias("at", "part")).groupBy("cluster", "at").agg(
        F.sum(F.col("part").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in total.collect():  # at most k * dims rows
        out[r["cluster"], r["at"]] = int(r["total"]) // r["n"]
    return out


def assigned(ints: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance`` (squared)."""
    dims = centroids.shape[1]
    normals, thresholds = bisectors(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int64)
            for at, v in _slices(batch.column(1), dims):
                nearest = tournament(v, normals, thresholds)
                off = v - centroids[nearest]
                cluster[at : at + len(v)] = nearest
                distance[at : at + len(v)] = np.einsum("nd,nd->n", off, off)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    kind = T.StructType([ints.schema["vec_id"]]).add("cluster", "integer").add("distance", "long")
    return ints.mapInArrow(run, kind)


def fit(ints: DataFrame, k: int = K, rounds: int = ROUNDS, seed: str = SEED) -> np.ndarray:
    """Centroids after ``rounds`` rounds, a row each."""
    centroids = first_centroids(ints, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(ints, centroids)
    return centroids


def cluster(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    rounds: int = ROUNDS,
    dims: int = DIMS,
    scale: int = SCALE,
    seed: str = SEED,
) -> DataFrame:
    """One row per usable vector: its cluster, squared distance, the inertia of its cluster and of all, and the centroid.

    ``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid`` (array of long),
    ``centroid_sha256`` (of its components in decimal, joined by commas).
    """
    spark = vectors.sparkSession
    ints = shared(integers(vectors, vec_id, vector, dims, scale), "integer-vectors")
    centroids = fit(ints, k, rounds, seed)
    if not len(centroids):
        centroids = np.zeros((1, dims), np.int64)  # nothing starts a centroid: all ids are null, or there is no row
        ints = ints.limit(0)
    found = shared(assigned(ints, centroids), "clusters")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    inertia = {r["cluster"]: int(r["s"]) for r in sums}  # at most k rows
    total = sum(inertia.values())
    facts = [
        (c, inertia[c], total, centroids[c].tolist(),
         hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
        for c in sorted(inertia)
    ]
    kind = "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string"
    return found.join(F.broadcast(spark.createDataFrame(facts, kind)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
