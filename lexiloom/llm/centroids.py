"""Centroid clustering of whole-number vectors by sort-means.

Vectors are packed into blocks of rows, two bytes a component where these do. In each round a block knows the centroid
that each of its vectors had before. For every centroid the others are ordered by
their distance from it; a vector looks through the list of its old centroid, from
the nearest on, and stops at the first that is strictly further from the old
centroid than twice the vector is, as by the triangle inequality no later one can
be nearer to the vector, nor as near. Distances are squared and exact, so ties go
to the smaller number for certain.

A round writes blocks with their new centroids and, for each block and centroid,
the sums that the next centroids need; these alone are read and added up by Spark.
Only sums of centroids reach the driver, and only centroids are sent out. Each
round's blocks are removed once the next are written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import forget, stored
from .common import bounded_batches, cut

K, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, "3"
#: Vectors of a block.
BLOCK = 4096
#: Components from here on have no exact squared distance in 64 bits.
BOUND = 1 << 27
_PARTS = "array<struct<cluster:int,n:bigint,inertia:bigint,sums:array<bigint>>>"
_STATE = f"ids array<bigint>, vectors binary, clusters binary, distances binary, parts {_PARTS}"


def whole_vectors(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``embeddings(vec_id, embedding, ...)`` -> vec_id and v, floor(scale * x) of each component x as a double.

    Kept are vectors with ``dimensions`` components, none null or non-finite, and
    none of a size of ``BOUND`` or more when scaled.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    rows = embeddings.where(F.size("embedding") == dimensions).select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x"))
    bad = lambda e: e.isNull() | F.isnan(e) | ~(F.abs(e) < F.lit(BOUND / scale))
    return rows.where(~F.exists("x", bad)).select("vec_id", F.transform("x", lambda e: F.floor(e * F.lit(float(scale)))).alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, seed: str = SEED) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``seed:vec_id``; rows that repeat an id in order of their components. Ids must not be null."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id is not null").select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in rows], np.int64)


def _distances(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = vectors - centroid
    return np.einsum("ij,ij->i", apart, apart)


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the numbers of all others, the nearest first, and their squared distances."""
    between = np.stack([_distances(centroids, c) for c in centroids])
    np.fill_diagonal(between, -1)  # each comes first in its own list, before those that are equal to it
    order = np.argsort(between, axis=1, kind="stable")[:, 1:]
    return order, np.take_along_axis(between, order, 1)


def assign(vectors: np.ndarray, before: np.ndarray, centroids: np.ndarray, lists: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector and the squared distance, from the centroid before; and how many distances it took. ``lists``: of ``neighbours``."""
    order, apart = lists or neighbours(centroids)
    nearest, least = before.astype(np.int64), np.empty(len(vectors), np.int64)
    taken = 0
    for old in np.unique(before):
        rows = np.flatnonzero(before == old)
        own = _distances(vectors[rows], centroids[old])
        rows = rows[np.argsort(-own, kind="stable")]  # those that stop last come first
        own = np.sort(own)[::-1]
        best, number = own.copy(), np.full(len(rows), old)
        taken += len(rows)
        for other, gap in zip(order[old].tolist(), apart[old].tolist(), strict=True):
            n = int(np.searchsorted(-own, gap // -4, side="right"))  # those that go on: gap <= 4 * own
            if not n:
                break
            d = _distances(vectors[rows[:n]], centroids[other])
            taken += n
            better = (d < best[:n]) | ((d == best[:n]) & (other < number[:n]))
            best[:n][better], number[:n][better] = d[better], other
        nearest[rows], least[rows] = number, best
    return nearest, least, taken


def _sums(vectors: np.ndarray, clusters: np.ndarray, distances: np.ndarray) -> list[dict]:
    return [{"cluster": int(c), "n": int(own.sum()), "inertia": int(distances[own].sum()), "sums": vectors[own].sum(axis=0)} for c in np.unique(clusters) for own in (clusters == c,)]


def _block(ids: pa.Array, vectors: np.ndarray, before: np.ndarray, centroids: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    clusters, distances, _ = assign(vectors, before, centroids, lists)
    parts = pa.array([_sums(vectors, clusters, distances)], pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("inertia", pa.int64()), ("sums", pa.list_(pa.int64()))])))
    width = "<i2" if len(vectors) and np.abs(vectors).max() < 1 << 15 else "<i4"
    packed = (vectors.astype(width), clusters.astype("<i4"), distances.astype("<i8"))
    held = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays([held, *[pa.array([x.tobytes()], pa.binary()) for x in packed], parts], names=["ids", "vectors", "clusters", "distances", "parts"])


def _unpacked(row: dict, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    clusters = np.frombuffer(row["clusters"], "<i4")
    width = len(row["vectors"]) // (dimensions * len(clusters))
    return np.frombuffer(row["vectors"], f"<i{width}").reshape(-1, dimensions).astype(np.int64), clusters


def _first_round(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of (vec_id, v); before the first round each vector has centroid 0."""
    lists = neighbours(centroids)
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            some = batch.slice(lo, BLOCK)
            vectors = some.column("v").flatten().to_numpy().reshape(some.num_rows, -1)
            yield _block(some.column("vec_id"), vectors, np.zeros(len(vectors), np.int64), centroids, lists)


def _next_round(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    lists = neighbours(centroids)
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in ("vectors", "clusters")}
            yield _block(batch.column("ids")[i].values, *_unpacked(row, centroids.shape[1]), centroids, lists)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch.column("ids")[i].values
            clusters, distances = (pa.array(np.frombuffer(batch.column(c)[i].as_py(), t)) for c, t in (("clusters", "<i4"), ("distances", "<i8")))
            yield pa.RecordBatch.from_arrays([ids, clusters, distances], names=["vec_id", "cluster", "distance"])


def _next_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the means of the vectors of each centroid; those without any stay."""
    parts = state.select(F.explode("parts").alias("p")).select("p.*")
    sums = parts.select("cluster", "n", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in sums.collect():  # a row for each centroid and component
        out[r["cluster"], r["at"]] = int(r["x"]) // r["n"]
    return out


def sort_means(vectors: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``vectors(vec_id, v)`` assigned ``rounds`` times, with new centroids each time, and then once more; the state's blocks and the last centroids."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    state, path = stored(vectors.mapInArrow(lambda it, c=centroids: _first_round(it, c), _STATE), "centroids")
    for _ in range(rounds):
        centroids = _next_centroids(state, centroids)
        blocks = state.select("ids", "vectors", "clusters")
        last, (state, path) = path, stored(blocks.mapInArrow(lambda it, c=centroids: _next_round(it, c), _STATE), "centroids")
        forget(spark, last)
    return state, centroids


def clusters(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """Cluster every vector of ``embeddings(vec_id, embedding, ...)``; see ``whole_vectors`` for those that are kept.

    Returns vec_id, cluster, distance (squared), cluster_inertia, inertia and
    centroid_sha256. With fewer than k ids there are fewer centroids. Rows that
    repeat an id, and rows without one, are vectors of their own; the latter are
    no first centroids, and if all are so, or none are kept, the result is empty.
    Other columns are ignored.
    """
    spark = embeddings.sparkSession
    vectors = cut(whole_vectors(embeddings, dimensions, scale))
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    state, centroids = sort_means(vectors, centroids, rounds)
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    parts = state.select(F.explode("parts").alias("p")).groupBy("p.cluster").agg(F.sum("p.inertia").alias("cluster_inertia"))
    inertia = {r["cluster"]: r["cluster_inertia"] for r in parts.collect()}  # k rows
    of = spark.createDataFrame([(i, inertia.get(i, 0), sum(inertia.values()), name) for i, name in names], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    rows = state.select("ids", "clusters", "distances").mapInArrow(_rows, "vec_id bigint, cluster int, distance bigint")
    return rows.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
