"""Centroid clustering of integer vectors with exact partial-distance search.

Rounds of assignment and replacement (Lloyd) over whole numbers. Every row stays in its partition: a task sums its
vectors by cluster, the executors add these sums up, and only counters of a fixed size (clusters x components)
meet in one place. In a task the distances to all centroids are first taken over the components of the highest
variance. The centroid closest there gives the first bound; each other one is followed over further components
only while its sum is not above the best full distance so far.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import merged_counters

DIM = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
ROWS = 4096  # rows compared at once
CUTS = (8, 16, 32)  # components after which rows may be given up
MOST = 1 << 27  # greatest magnitude of a component: distances and sums stay below 2^63


def kept_vectors(batch: pa.RecordBatch, dim: int, scale: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and floor(scale * x) of the vectors that have ``dim`` components, all finite."""
    ids, col = batch.column(0), batch.column(1)
    start, end = col.offsets[:-1].to_numpy(), col.offsets[1:].to_numpy()
    x = col.values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])  # a null is NaN here
    whole = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False) & (end - start == dim) & (bad[end] == bad[start]))
    out = np.floor(scale * x[start[whole, None] + np.arange(dim)])
    if (np.abs(out) > MOST).any():
        raise ValueError(f"a component is over {MOST} in magnitude after scaling")
    return ids.take(pa.array(whole)), out.astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, cuts: tuple[int, ...] = CUTS) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the nearest centroid, ties to the smaller number, and its squared distance.

    ``order`` lists the components in the order in which they are added up; it has no effect on the result.
    """
    xs, cs, k = np.ascontiguousarray(x[:, order]), centroids[:, order], len(centroids)
    steps = [c for c in cuts if c < xs.shape[1]] + [xs.shape[1]]
    part = np.empty((k, len(xs)), np.int64)
    for j in range(k):
        d = xs[:, : steps[0]] - cs[j, : steps[0]]
        part[j] = np.einsum("ij,ij->i", d, d)
    which = part.argmin(axis=0)
    d = xs - cs[which]
    best = np.einsum("ij,ij->i", d, d)
    for j in range(k):
        alive = np.flatnonzero((part[j] <= best) & (which != j))
        total = part[j][alive]
        for lo, hi in zip(steps, steps[1:]):
            d = xs[alive, lo:hi] - cs[j, lo:hi]
            total = total + np.einsum("ij,ij->i", d, d)
            there = total <= best[alive]
            alive, total = alive[there], total[there]
        closer = (total < best[alive]) | (j < which[alive])
        best[alive[closer]], which[alive[closer]] = total[closer], j
    return which, best


def cluster(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector.

    Kept are vectors of exactly ``dim`` components, none null or non-finite, as whole numbers floor(scale * x).
    The first centroids are the kept vectors of the smallest sha256 of ``seed:id``, of repeated ids the smaller vector
    first, null ids last; fewer kept vectors give fewer centroids. After each round a centroid is the floor of its
    vectors' mean, componentwise; one without vectors stays. Null ids are clustered like others and repeated rows
    each count. No kept vector gives an empty result. Components of a magnitude over ``MOST`` after scaling are an
    error. Other columns are not read.
    """
    spark = rows.sparkSession
    data = rows.select(F.col(id_col), F.col(vector_col).cast("array<double>"))
    schema = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    named = data.toDF("id", "v").where(f"size(v) = {dim} and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    first = named.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)).orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters).collect()
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array([np.floor(scale * np.array(r["v"])) for r in first])
    if (np.abs(centroids) > MOST).any():
        raise ValueError(f"a component is over {MOST} in magnitude after scaling")
    centroids, k = centroids.astype(np.int64), len(first)

    def blocks(batches) -> Iterator[tuple[pa.Array, np.ndarray]]:
        for b in batches:
            ids, x = kept_vectors(b, dim, scale)
            for lo in range(0, len(x), ROWS):
                yield ids[lo : lo + ROWS], x[lo : lo + ROWS]

    def moments(batches):
        out = np.zeros(2 * dim + 1, np.float64)
        for _, x in blocks(batches):
            out += np.concatenate([x.sum(axis=0), (x.astype(float) ** 2).sum(axis=0), [len(x)]])
        return np.clip(out, -(2.0**40), 2.0**40).astype(np.int64)

    m = merged_counters(data, moments, 2 * dim + 1, np.int64, 1).astype(float)
    order = np.argsort(-(m[dim : 2 * dim] / m[-1] - (m[:dim] / m[-1]) ** 2), kind="stable")  # an order only: rounding does no harm

    def assigned(centroids):
        known = spark.sparkContext.broadcast((centroids, order))

        def over(batches):
            for ids, x in blocks(batches):
                yield ids, x, *nearest(x, *known.value)

        return over

    def sums(over):
        def of(batches):
            total = np.zeros((k, dim + 1), np.int64)
            for _, x, which, _ in over(batches):
                held = np.argsort(which, kind="stable")
                found, at = np.unique(which[held], return_index=True)
                total[found, :dim] += np.add.reduceat(x[held], at, axis=0)
                total[:, dim] += np.bincount(which, minlength=k)
            return total.ravel()

        return of

    for _ in range(rounds):
        total = merged_counters(data, sums(assigned(centroids)), k * (dim + 1), np.int64, 4).reshape(k, dim + 1)
        n = total[:, dim :]
        centroids = np.where(n > 0, total[:, :dim] // np.maximum(n, 1), centroids)

    last = assigned(centroids)

    def distances(batches):
        total = np.zeros(k, np.int64)
        for _, _, which, best in last(batches):
            np.add.at(total, which, best)
        return total

    inertia = merged_counters(data, distances, k, np.int64, 1)
    marks = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    ends = spark.sparkContext.broadcast((inertia, pa.array(marks)))

    def final(batches):
        each, said = ends.value
        for ids, _, which, best in last(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(which.astype(np.int32)), pa.array(best), pa.array(each[which]), pa.array(np.full(len(which), each.sum())), said.take(pa.array(which))], schema.names)

    return data.mapInArrow(final, schema)
