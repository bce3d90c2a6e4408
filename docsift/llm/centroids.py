"""Centroid clustering in exact integers, with geometric drift tightening.

Lloyd's rounds over integer vectors.  A vector's cluster is kept without looking at the other
centroids as long as its exact distance to its own one is under a lower bound of its distance to
all others.  When centroids move, the bound is loosened by less than the full drift:

A cluster's members lie in a sphere about its old centroid.  Let another centroid move by p
along an axis.  In the half-plane of the axis and a member, the member's distance to the moving
point falls at the rate cos(theta), theta being the angle at that point between the axis and the
member; theta only grows as the point moves on.  The least theta of the whole sphere is that of
the tangent from the point, phi - asin(r / D), so the distance falls by at most the sum over
short steps of p of the cosines at their beginnings (which is negative where the centroid moves
away, and then the bound is tightened).  The sphere and two places of a centroid thus bound all
members at once.

Vectors that the bounds leave ambiguous are scanned exactly; integers make distances, ties and
sums exact.  Vectors travel in blocks, each a row with its state (clusters and bounds), and a
round is one map-only pass that writes the blocks anew and one row of sums a task.  The driver
holds the centroids and their sums: k x dimension numbers, whatever the table's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, save_table

#: Vectors in a block, about.
BLOCK = 4096
#: Steps of a drift whose cosines are summed.
STEPS = 16
#: Integers of this size have exact distances in longs.
LARGEST = 1 << 26

STATE = pa.schema([("ids", pa.list_(pa.int64())), ("matrix", pa.binary()), ("cluster", pa.list_(pa.int32())),
                   ("lower", pa.list_(pa.float64())), ("distance", pa.list_(pa.int64())),
                   ("sums", pa.list_(pa.int64())), ("radius", pa.list_(pa.float64()))])
STATE_DDL = ("ids array<long>, matrix binary, cluster array<int>, lower array<double>, distance array<long>, "
             "sums array<long>, radius array<double>")


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of x to every row of c (integers)."""
    most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4 * x.shape[1] * int(most) ** 2 < 1 << 53:  # doubles hold every term and sum
        f, g = x.astype(float), c.astype(float)
        return ((f * f).sum(axis=1)[:, None] - 2 * (f @ g.T) + (g * g).sum(axis=1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def fall(centre: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> float:
    """How much the distance of any point of a sphere to a centroid may fall as that moves."""
    drift = float(np.linalg.norm(new - old))
    if not drift:
        return 0.0
    along = float((centre - old) @ (new - old)) / drift
    off = np.sqrt(max(0.0, float((centre - old) @ (centre - old)) - along ** 2))
    x = along - drift * np.arange(STEPS) / STEPS
    far = np.hypot(x, off)
    outside = far > radius
    tangent = np.arctan2(off, x) - np.arcsin(np.where(outside, radius / np.maximum(far, radius + 1e-300), 1.0))
    steepest = np.where(outside, np.maximum(tangent, 0.0), 0.0)
    return float(drift / STEPS * np.cos(steepest).sum()) + 1e-9 * (1 + drift + np.linalg.norm(centre - old))


@dataclass
class Round:
    """The centroids of a round, how much each cluster's lower bounds are loosened, and half the
    distance of each centroid to its nearest other one."""

    centroids: np.ndarray
    loosen: np.ndarray
    half: np.ndarray

    @staticmethod
    def of(new: np.ndarray, old: np.ndarray | None = None, radius: np.ndarray | None = None) -> Round:
        k = len(new)
        c = new.astype(float)
        gaps = np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=2)) + np.where(np.eye(k, dtype=bool), np.inf, 0)
        loosen = np.full(k, np.inf)
        if old is not None and k > 1:
            o = old.astype(float)
            for i in np.flatnonzero(radius >= 0):
                loosen[i] = max(fall(o[i], radius[i], o[j], c[j]) for j in range(k) if j != i)
        return Round(new, loosen, gaps.min(axis=1, initial=np.inf) / 2 * (1 - 1e-12) - 1e-9)


def assign(x: np.ndarray, r: Round, cluster: np.ndarray | None, lower: np.ndarray | None):
    """Cluster, lower bound and exact squared distance of each vector, and how many were scanned."""
    n = len(x)
    if cluster is None:
        cluster, lower, scan = np.zeros(n, np.int32), np.full(n, -np.inf), np.ones(n, bool)
        distance = np.zeros(n, np.int64)
    else:
        distance = ((x - r.centroids[cluster]) ** 2).sum(axis=1)
        lower = lower - r.loosen[cluster]
        upper = np.sqrt(distance.astype(float)) * (1 + 1e-12)
        scan = ~((upper < lower) | (upper < r.half[cluster]))
        cluster = cluster.copy()
    if scan.any():
        d = squared(x[scan], r.centroids)
        cluster[scan] = best = d.argmin(axis=1)  # ties: the smaller number
        distance[scan] = d[np.arange(len(d)), best]
        d[np.arange(len(d)), best] = np.iinfo(np.int64).max
        lower[scan] = np.sqrt(d.min(axis=1).astype(float)) * (1 - 1e-12) if d.shape[1] > 1 else np.inf
    return cluster, lower, distance, int(scan.sum())


class _Sums:
    """Per cluster: components, count, distances; and the vectors scanned."""

    def __init__(self, k: int, dim: int):
        self.table = np.zeros((k, dim + 2), np.int64)
        self.radius = np.full(k, -1.0)
        self.scanned = 0

    def add(self, x: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> None:
        rows = np.concatenate([x, np.ones((len(x), 1), np.int64), distance[:, None]], axis=1)
        for c in np.unique(cluster):
            self.table[c] += rows[cluster == c].sum(axis=0)
        np.maximum.at(self.radius, cluster, np.sqrt(distance.astype(float)) * (1 + 1e-12))

    def row(self) -> pa.RecordBatch:
        flat = [*self.table.ravel().tolist(), self.scanned]
        return pa.RecordBatch.from_pylist([{"sums": flat, "radius": self.radius.tolist()}], schema=STATE)


def _state(ids, x, cluster, lower, distance) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"ids": ids, "matrix": x.astype("<i4").tobytes(), "cluster": cluster.tolist(),
                                        "lower": lower.tolist(), "distance": distance.tolist()}], schema=STATE)


def _first(batches: Iterator[pa.RecordBatch], r: Round, scale: int) -> Iterator[pa.RecordBatch]:
    k, dim = r.centroids.shape
    sums = _Sums(k, dim)
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            real = np.floor(scale * part.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
            _check(real)
            x = real.astype(np.int64)
            cluster, lower, distance, scanned = assign(x, r, None, None)
            sums.add(x, cluster, distance)
            sums.scanned += scanned
            yield _state(part.column(0).to_pylist(), x, cluster, lower, distance)
    yield sums.row()


def _check(real: np.ndarray) -> None:
    if np.abs(real).max(initial=0) > LARGEST:
        raise OverflowError(f"scaled components over {LARGEST} have no exact distances in 64 bits")


def _next(batches: Iterator[pa.RecordBatch], r: Round) -> Iterator[pa.RecordBatch]:
    k, dim = r.centroids.shape
    sums = _Sums(k, dim)
    for batch in batches:
        for i in range(batch.num_rows):
            ids, matrix, cluster, lower = (batch.column(n)[i] for n in ("ids", "matrix", "cluster", "lower"))
            x = np.frombuffer(matrix.as_buffer(), "<i4").reshape(-1, dim).astype(np.int64)
            cluster, lower, distance, scanned = assign(x, r, cluster.values.to_numpy(), lower.values.to_numpy())
            sums.add(x, cluster, distance)
            sums.scanned += scanned
            yield _state(ids.as_py(), x, cluster, lower, distance)
    yield sums.row()


def _totals(table: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums by cluster and number, radii, vectors scanned: k x (dimension + 2) rows."""
    rows = table.where(F.col("ids").isNull())
    flat = [0] * (k * (dim + 2) + 1)
    for at, s in rows.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s")).collect():
        flat[at] = s
    radius = np.full(k, -1.0)
    for at, s in rows.select(F.posexplode("radius").alias("at", "s")).groupBy("at").agg(F.max("s")).collect():
        radius[at] = s
    return np.array(flat[:-1], np.int64).reshape(k, dim + 2), radius, flat[-1]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(i).flatten() for i in range(3)], names=["vec_id", "cluster", "distance"])


def centroid_clusters(vectors: DataFrame, k: int, rounds: int, dim: int, scale: int = 1024, seed: str = "3",
                      id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``, one row a vector.

    Vectors with exactly ``dim`` components, none null or non-finite, take part; the others have
    no row.  A component x becomes floor(``scale`` * x); over 2**26 it is an error.  Centroids
    start as the k vectors with the smallest sha256 of ``seed:id`` (all, if fewer; of rows that
    share an id, the smaller vector first; a null id starts none).  An empty cluster's centroid
    stays.  A null id is kept in the result.  An empty table, or none that takes part, gives no rows.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    kept = (vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
            .where(F.coalesce((F.size(v) == dim) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))),
                              F.lit(False))))
    start = (kept.where(F.col("vec_id").isNotNull())
             .withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
             .orderBy("h", "v").limit(k).collect())
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], schema)
    real = np.floor(scale * np.array([r.v for r in start]))
    _check(real)
    r, k = Round.of(real.astype(np.int64)), len(start)
    table = save_table(kept.mapInArrow(lambda b: _first(b, r, scale), STATE_DDL), "centroids")
    for n in range(rounds + 1):
        sums, radius, _ = _totals(table, k, dim)
        if n == rounds:
            break
        new = r.centroids.copy()
        for i in np.flatnonzero(sums[:, dim]):
            new[i] = sums[i, :dim] // sums[i, dim]
        r = Round.of(new, r.centroids, radius)
        before, blocks = table, table.where(F.col("ids").isNotNull())
        table = save_table(blocks.mapInArrow(lambda b, r=r: _next(b, r), STATE_DDL), "centroids")
        drop_saved(before)
    inertia = [int(s) for s in sums[:, dim + 1]]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in r.centroids.tolist()]
    about = spark.createDataFrame([(i, inertia[i], sum(inertia), digests[i]) for i in range(k)],
                                  "c_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = (table.where(F.col("ids").isNotNull()).select("ids", "cluster", "distance")
            .mapInArrow(_rows, "vec_id long, cluster int, distance long"))
    # one row for each of the k clusters
    return rows.join(F.broadcast(about), F.col("cluster") == F.col("c_cluster")).drop("c_cluster")
