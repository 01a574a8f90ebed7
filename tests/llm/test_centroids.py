"""Centroid clustering against plain integer arithmetic, on ties, repeats and odd vectors."""

import hashlib
import math

import numpy as np
import pytest

SCHEMA = "vec_id long, embedding array<float>"


def plain_clusters(rows, clusters=40, rounds=5, dim=64):
    """(id, cluster, distance, cluster inertia, inertia, hash) by plain loops."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in seeds[:clusters]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((min(range(len(d)), key=lambda j: (d[j], j)), min(d)))
        return out

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (c, _) in zip(kept, found) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    each = [sum(d for c, d in found if c == j) for j in range(len(centroids))]
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((repr(i), c, d, each[c], sum(each), marks[c]) for (i, _), (c, d) in zip(kept, found))


def as_rows(df):
    return sorted((repr(r[0]), *r[1:6]) for r in df.collect())


def test_clusters_against_plain_arithmetic(spark):
    from rolefinch.llm.centroids import cluster

    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 64)]) for i in range(300)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(60)]  # copies of a few vectors: ties, empty centroids
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert as_rows(cluster(df)) == plain_clusters(rows)


def test_clusters_of_odd_vectors(spark):
    from rolefinch.llm.centroids import cluster

    v = [0.25] * 64
    rows = [(1, v), (1, v), (2, [0.5] * 64), (None, v), (3, None), (4, v[:63]), (5, v + [1.0]), (6, [None] + v[1:]), (7, [float("nan")] + v[1:]), (8, [float("inf")] + v[1:]), (9, []), (10, [-1e-9] + v[1:])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert as_rows(cluster(df)) == plain_clusters(rows) and len(as_rows(cluster(df))) == 5
    assert cluster(df.where("false")).collect() == [] and cluster(df.where("vec_id = 3")).collect() == []
    clash = df.selectExpr("*", "'z' as id", "1 as v", "'z' as h", "'z' as cluster", "2 as distance", "3L as inertia")
    assert as_rows(cluster(clash)) == as_rows(cluster(df))
    with pytest.raises(Exception, match="in magnitude"):
        cluster(spark.createDataFrame([(1, [1e12] + v[1:])], SCHEMA)).collect()


def test_partial_distances_against_whole_ones():
    from rolefinch.llm.centroids import nearest

    rng = np.random.default_rng(8)
    for spread in (1, 3, 1000):
        x, c = rng.integers(-spread, spread + 1, (500, 64)), rng.integers(-spread, spread + 1, (40, 64))
        c[7] = c[31]  # ties
        x[::9] = c[rng.integers(0, 40, len(x[::9]))]
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        which, best = nearest(x, c, rng.permutation(64))
        assert (which == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
