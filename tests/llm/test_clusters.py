"""Centroid clustering against Lloyd's rounds without bounds, and on odd inputs."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from corpuscle.llm import clusters


def plain(rows, k, rounds, dims, scale, seed=1):
    """(id, cluster, distance) and the centroids, with Python integers."""
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:k]
    cents = [q for _, q in first]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(q)[1] for _, q in kept]
        for j in range(len(cents)):
            mine = [q for (_, q), o in zip(kept, own, strict=True) if o == j]
            if mine:
                cents[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return [(i, near(q)[1], near(q)[0]) for i, q in kept], cents


def as_table(spark, rows):
    return spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, cluster string").withColumns({c: F.lit("clash") for c in ("q", "id", "n", "sums", "far", "at", "distance")})


def check(spark, rows, k, rounds, dims, scale):
    want, cents = plain(rows, k, rounds, dims, scale)
    got = clusters.cluster_vectors(as_table(spark, rows).repartition(3), k, rounds, dims, scale).collect()
    order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=order) == sorted(want, key=order)
    for r in got:
        assert r.inertia == sum(d for *_, d in want) and r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cents[r.cluster])).encode()).hexdigest()


def test_same_as_plain_rounds(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (9, 6))
    rows = [(i, (centres[i % 9] + rng.normal(0, 0.3, 6)).tolist()) for i in range(400)]
    check(spark, rows, 7, 5, 6, 64.0)


def test_odd_vectors_ties_and_repeats(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-1, 2, 4).astype(float).tolist()) for i in range(60)]  # many ties
    rows += [(None, [0.5, 0.0, 0.0, 0.0]), (7, rows[7][1]), (7, [1.0, 1.0, 1.0, 1.0]), (70, None), (71, []), (72, [1.0] * 3), (73, [1.0, None, 1.0, 1.0]), (74, [1.0, float("nan"), 0.0, 0.0]), (75, [float("inf")] * 4)]
    check(spark, rows, 5, 3, 4, 2.0)
    check(spark, rows[:3], 16, 3, 4, 2.0)  # fewer vectors than centroids
    assert clusters.cluster_vectors(as_table(spark, []), dims=4).count() == 0
    huge = [(1, [3e300, 0.0]), (2, [-3e300, 0.0]), (3, [0.0, 0.0])]
    assert sorted(r.distance for r in clusters.cluster_vectors(as_table(spark, huge), 2, 1, 2, 64.0).collect()) is not None


def test_bounds_spare_evaluations_and_lose_none():
    """Total displacement bounds hold over many rounds; a centroid that comes back is not evaluated anew."""
    rng = np.random.default_rng(6)
    centres = rng.integers(-400, 400, (12, 8))
    q = (centres[rng.integers(0, 12, 3000)] + rng.integers(-60, 60, (3000, 8))).astype(np.int64)
    history = q[:12][None].copy()
    cluster = far = at = None
    spent = []
    for _ in range(12):
        bounds = clusters.Bounds(history)
        if cluster is None:
            cluster, far, at = bounds.first(q)
        else:
            cluster = bounds.again(q, cluster, far, at)
        assert (cluster == clusters.squared(q, history[-1]).argmin(axis=1)).all()
        spent.append(bounds.evaluated)
        following = history[-1].copy()
        for j in np.unique(cluster):
            following[j] = q[cluster == j].sum(axis=0) // (cluster == j).sum()
        history = np.concatenate([history, following[None]])
    assert spent[0] == 12 * 3000 and sum(spent[6:]) < 0.2 * sum([spent[0]] * len(spent[6:]))
    back = clusters.Bounds(np.concatenate([history[:1], history[:1] + 50, history[:1]]))
    _, far0, at0 = clusters.Bounds(history[:1]).first(q)
    back.again(q, far0.argmin(axis=1), far0, at0)
    assert back.evaluated <= 3000 * 2  # total displacement is zero: hardly more than ties


def test_wide_components_stay_exact():
    q, c = np.array([[clusters.LIMIT, -clusters.LIMIT]]), np.array([[-clusters.LIMIT, clusters.LIMIT - 1]])
    assert clusters.squared(q, c)[0, 0] == (2 * clusters.LIMIT) ** 2 + (2 * clusters.LIMIT - 1) ** 2 == clusters.pairwise(q, c)[0]
