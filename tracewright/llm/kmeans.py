"""Operator 12: exact k-means with clusters as balls.

A cluster is a ball around its centroid. When a centroid has moved, the ball's radius is at most the old one plus the way
it moved, and only centroids nearer than twice the radius are neighbours: no member can be nearer to any other. A member
nearer to its centroid than half the way to the next neighbour is in the stable core and stays. The others lie in annuli, bounded
by half the ways to the neighbours in order of distance; a member is compared with the neighbours inside its annulus
alone. At first all vectors are members of ball 0, whose radius has no bound. All comparisons are of whole numbers, so the result
is that of comparing every vector with every centroid.

A round is one pass over the vectors, which stay where they are; tasks add their members up, and a sum for each cluster
and component (k times 64 numbers) is all that travels.

Vectors that are null, of another length or with a null or non-finite component are left out. Components whose 64th part
passes 2^20 are held at 2^26, so that squared distances fit a long; sums of distances that do not are null. Repeated rows and ids
are vectors of their own (among equal ids the smaller vector is the first centroid); a null id counts as the text ``null``.
With fewer than 16 vectors there are as many centroids as vectors; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

K, SIZE, ROUNDS, SCALE = 16, 64, 3, 64
#: Largest component, either way.
LIMIT = 1 << 26


def whole(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array<int>) of the vectors that count."""
    x = F.col("embedding").cast("array<double>")
    fine = (F.size(x) == size) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    held = lambda c: F.greatest(F.least(F.floor(c * scale), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int")
    return vectors.select("vec_id", x.alias("embedding")).where(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform("embedding", lambda c: held(F.greatest(F.least(c, F.lit(float(LIMIT))), F.lit(-float(LIMIT))))).alias("v"))


class Balls:
    """Centroids with the neighbours that their members may be nearer to."""

    def __init__(self, centroids: np.ndarray, radii: np.ndarray):
        self.centroids = centroids
        self.ways = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
        self.near: list[np.ndarray] = []
        for k, way in enumerate(self.ways):
            order = np.argsort(way, kind="stable")
            # a member can only be as near to j as to its own centroid if the way to j is at most twice the radius
            self.near.append(order[(order != k) & (np.sqrt(way[order].astype(float)) <= 2 * radii[k] * (1 + 1e-9))])

    def assign(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid (the smaller number of equals) and squared distance of members of ``own``, and how many distances
        were computed."""
        best, least = own.copy(), ((x - self.centroids[own]) ** 2).sum(1)
        asked = len(x)
        for k in np.unique(own).tolist():
            rows, near = np.flatnonzero(own == k), self.near[k]
            # the annulus of each member: how many neighbours are within twice its distance; 0 is the stable core
            inside = np.searchsorted(self.ways[k][near], 4 * least[rows], side="right")
            for place, j in enumerate(near.tolist()):
                met = rows[inside > place]
                if not len(met):
                    break
                asked += len(met)
                d = ((x[met] - self.centroids[j]) ** 2).sum(1)
                nearer = (d < least[met]) | ((d == least[met]) & (j < best[met]))
                best[met[nearer]], least[met[nearer]] = j, d[nearer]
        return best, least, asked


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def assigned(vectors: DataFrame, balls: Balls) -> DataFrame:
    """vec_id, v, cluster, distance under new centroids; ``vectors`` has the old cluster."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            if b.num_rows:
                best, least, _ = balls.assign(_matrix(b.column(1)), b.column(2).to_numpy(zero_copy_only=False).astype(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best, pa.int32()), pa.array(least, pa.int64())], ["vec_id", "v", "cluster", "distance"])

    return vectors.select("vec_id", "v", "cluster").mapInArrow(run, f"vec_id {kind}, v array<int>, cluster int, distance long")


def moved(members: DataFrame, balls: Balls) -> Balls:
    """The balls around the floored means of their members; empty ones stay where they are."""

    def run(batches):
        sums, counts, far = {}, {}, {}
        for b in batches:
            x, own, d = _matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            for k in np.unique(own).tolist():
                mine = own == k
                sums[k] = sums.get(k, 0) + x[mine].sum(0)
                counts[k], far[k] = counts.get(k, 0) + int(mine.sum()), max(far.get(k, 0), int(d[mine].max()))
        for k in sums:
            yield pa.RecordBatch.from_pydict({"cluster": pa.array([k], pa.int32()), "n": pa.array([counts[k]], pa.int64()), "far": pa.array([far[k]], pa.int64()), "s": pa.array([sums[k]], pa.list_(pa.int64()))})

    parts = members.select("v", "cluster", "distance").mapInArrow(run, "cluster int, n long, far long, s array<bigint>")
    each = parts.select("cluster", "n", "far", F.posexplode("s").alias("i", "x"))
    centroids, radii = balls.centroids.copy(), np.zeros(len(balls.centroids))
    for r in each.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.sum("x").alias("x")).collect():  # k * 64 rows
        centroids[r.cluster, r.i] = r.x // r.n
        radii[r.cluster] = math.sqrt(r.far)
    return Balls(centroids, radii + np.sqrt(((centroids - balls.centroids) ** 2).sum(1).astype(float)))


def first_centroids(vectors: DataFrame, k: int = K, seed: str = "1:") -> np.ndarray:
    """The vectors of the ``k`` smallest digests of their ids."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    return np.array([r.v for r in vectors.orderBy(digest, "v").select("v").limit(k).collect()], np.int64)


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that counts."""
    spark = vectors.sparkSession
    base = whole(vectors)
    start = first_centroids(base, k)
    balls = Balls(start.reshape(len(start), SIZE), np.full(len(start), math.inf))
    now = base.withColumn("cluster", F.lit(0))
    for _ in range(rounds + 1):
        old, now = now, cut(assigned(now, balls), "clusters")
        drop(old)
        if _ < rounds:
            balls = moved(now, balls)
    own = {r.cluster: r.d for r in now.groupBy("cluster").agg(F.try_sum("distance").alias("d")).collect()}  # k rows
    most = (1 << 63) - 1
    every = sum(own.values()) if None not in own.values() else None
    rows = [(c, d, every if every is not None and every <= most else None, hashlib.sha256(",".join(map(str, balls.centroids[c].tolist())).encode()).hexdigest()) for c, d in own.items()]
    said = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return now.drop("v").join(F.broadcast(said), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
