"""Centroid clustering with ns-bounds.

Vectors become integers, ``floor(scale * x)``, so every distance, sum and centroid is exact. A vector
keeps, for each centroid, the squared distance at its last evaluation and the round of that evaluation.
The driver keeps the history of all centroids (``k * dims`` numbers a round). A stored distance, as of
round s, bounds the present one by the norm of the centroid's *total* displacement since s, not by the
sum of its moves: lower bounds are loosened by it, the upper bound of the own centroid likewise. Where
a lower bound does not clear the upper one, the own distance is evaluated anew, and then each centroid
whose bound still fails, exactly; what clears can be neither nearer nor tied.

A round is one pass of tasks over the table: vectors and bounds go from one Parquet stash to the next
without a shuffle, and each task closes with a row a cluster, number and sum of its vectors, in columns
of their own, so that the new centroids come from reading these columns alone. A lost executor costs its
tasks; a stash is deleted when the next one is whole. On disk are two states of (4 + 9 k / dims) bytes a
component at most.

Defined cases: vectors that are null, of other than ``dims`` components or with null or non-finite ones
take no part. Components beyond +-2^27 count as +-2^27 (else squared distances pass 64 bits); inertia
ends at 2^63 - 1. Rows with a null id are clustered, but start no centroid. Repeated ids are separate
rows; of equal hashes the smaller vector starts first. Fewer vectors than ``k`` give as many centroids;
an empty table gives no rows. Ties of distance go to the smaller number. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.session import Scratch

LIMIT = 1 << 27
MOST = (1 << 63) - 1
STATE = "id long, q array<int>, cluster int, far array<long>, at array<int>, n long, sums array<long>"
KINDS = [("id", pa.int64()), ("q", pa.list_(pa.int32())), ("cluster", pa.int32()), ("far", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]


def quantised(vectors: DataFrame, dims: int, scale: float, id_col: str, vec_col: str) -> DataFrame:
    """id and q, the integer components, of every vector that takes part."""
    x = F.col(vec_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    whole = F.transform(x, lambda v: F.greatest(F.least(F.floor(v * scale), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    return vectors.filter((F.size(vec_col) == dims) & finite).select(F.col(id_col).cast("long").alias("id"), whole.alias("q"))


def squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``q`` to rows of ``c``; in floating point only where all sums stay below 2^53."""
    top = max(int(np.abs(q).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * top * top * max(q.shape[1], 1) < 1 << 53:
        a, b = q.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    out = np.empty((len(q), len(c)), np.int64)
    for j, row in enumerate(c):
        out[:, j] = ((q - row) ** 2).sum(axis=1)
    return out


def pairwise(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    return ((q - c) ** 2).sum(axis=1)


class Bounds:
    """Assignment in round ``now`` under the centroids' history (rounds, k, dims)."""

    def __init__(self, history: np.ndarray) -> None:
        self.history, self.now = history, len(history) - 1
        moved = (history[-1][None] - history).astype(np.float64)
        self.moved = np.sqrt((moved * moved).sum(axis=2))
        self.evaluated = 0

    def first(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        far = squared(q, self.history[self.now])
        self.evaluated += far.size
        return far.argmin(axis=1), far, np.full(far.shape, self.now, np.int32)

    def failing(self, cluster: np.ndarray, far: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each centroid may be as near as the own one; rounding errs towards yes."""
        rows, k = np.arange(len(far)), far.shape[1]
        loose = self.moved[at, np.arange(k)]
        root = np.sqrt(far.astype(np.float64))
        own = (root[rows, cluster] + loose[rows, cluster]) * (1 + 1e-9) + 1e-6
        fails = (root - loose) * (1 - 1e-9) - 1e-6 <= own[:, None]
        fails[rows, cluster] = False
        return fails

    def evaluate(self, q: np.ndarray, i: np.ndarray, j: np.ndarray, far: np.ndarray, at: np.ndarray) -> None:
        far[i, j] = pairwise(q[i], self.history[self.now][j])
        at[i, j] = self.now
        self.evaluated += len(i)

    def again(self, q: np.ndarray, cluster: np.ndarray, far: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The new clusters; ``far`` and ``at`` are brought up to date in place."""
        i = np.flatnonzero(self.failing(cluster, far, at).any(axis=1))
        i = i[at[i, cluster[i]] < self.now]
        self.evaluate(q, i, cluster[i], far, at)
        i, j = np.nonzero(self.failing(cluster, far, at))
        stale = at[i, j] < self.now
        self.evaluate(q, i[stale], j[stale], far, at)
        rows = np.unique(i)
        if not len(rows):
            return cluster
        valid = at[rows] == self.now
        cluster = cluster.copy()
        cluster[rows] = np.where(valid, far[rows], np.iinfo(np.int64).max).argmin(axis=1)
        return cluster


def matrix(lists: pa.Array, width: int, kind: type) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(lists), width)


def listed(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel(), kind))


def state_rows(rows: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[n].cast(t) if n in columns else pa.nulls(rows, t) for n, t in KINDS], [n for n, _ in KINDS])


def round_rows(rows: DataFrame, history: np.ndarray, last: bool) -> DataFrame:
    """One round: every vector with its cluster and bounds, and each task's number and sum of vectors a cluster (not in the ``last`` round)."""
    k, dims = history.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(history)
        count, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in (b.slice(lo, 8192) for b in batches for lo in range(0, b.num_rows, 8192)):
            q = matrix(b.column("q"), dims, np.int64)
            if len(history) == 1:
                cluster, far, at = bounds.first(q)
            else:
                cluster, far, at = b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64), matrix(b.column("far"), k, np.int64), matrix(b.column("at"), k, np.int32)
                cluster = bounds.again(q, cluster, far, at)
            if last:
                i = np.flatnonzero(at[np.arange(len(q)), cluster] < bounds.now)
                bounds.evaluate(q, i, cluster[i], far, at)
            np.add.at(count, cluster, 1)
            np.add.at(sums, cluster, q)
            yield state_rows(len(q), id=b.column("id"), q=b.column("q"), cluster=pa.array(cluster, pa.int32()), far=listed(far, pa.int64()), at=listed(at, pa.int32()))
        own = np.flatnonzero(count)
        if len(own) and not last:
            yield state_rows(len(own), cluster=pa.array(own, pa.int32()), n=pa.array(count[own], pa.int64()), sums=listed(sums[own], pa.int64()))

    return rows.mapInArrow(run, STATE)


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster, from the tasks' sums; a cluster without vectors stays."""
    parts = state.filter("n is not null").select("cluster", "n", F.posexplode("sums"))
    total = parts.groupBy("cluster", "pos").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()
    out = centroids.copy()
    for r in total:
        out[r["cluster"], r["pos"]] = int(r["s"]) // int(r["n"])
    return out


def starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ids' hashes come first."""
    drawn = rows.filter("id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return np.array([r["q"] for r in sorted(drawn, key=lambda r: (r["h"], r["q"]))], np.int64)


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector after ``rounds`` rounds and a last assignment.

    Centroids start as the vectors with the smallest sha256 of ``seed:id``.
    """
    spark = vectors.sparkSession
    held, state = Scratch(spark), quantised(vectors, dims, scale, id_col, vec_col)
    first = starts(state, k, seed)
    names = f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(first):
        return spark.createDataFrame([], names)
    history = first[None]
    for i in range(rounds + 1):
        following = Scratch(spark)
        state = following.stash(round_rows(state.filter("n is null") if i else state, history, i == rounds), "clusters")
        held.clear()
        held = following
        if i < rounds:
            history = np.concatenate([history, moved_centroids(state, history[-1])[None]])
    got = state.select(F.col("id").alias(id_col), "cluster", F.element_at("far", F.col("cluster") + 1).alias("distance"))
    spent = {r["cluster"]: int(r["s"]) for r in got.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    final = [(j, min(spent.get(j, 0), MOST), digest(c)) for j, c in enumerate(history[-1])]
    about = spark.createDataFrame(final, "cluster int, cluster_inertia long, centroid_sha256 string")
    out = got.join(F.broadcast(about), "cluster").withColumn("inertia", F.lit(min(sum(spent.values()), MOST)).cast("long"))
    return out.select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
