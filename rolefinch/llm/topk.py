"""Exact top-k inner-product search by distributed histogram selection.

Each block of queries is scored against every row, several times. The first passes only fill histograms, one
row of counters for each query, which the executors add up; each pass splits the bin that holds the k-th best
score until that bin is one score wide. A last pass keeps what lies above it and, of the rows tied with it,
the smallest ids. Nothing but counters of a fixed size and at most k rows for each query and task is moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import merged_counters, stage, unstage

BINS = 512
QUERY_BLOCK = 4096  # queries broadcast and scored at once
ROWS = 2048  # rows scored at once


def quantized(batch: pa.RecordBatch, scale: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and floor(scale * x) of the vectors that are whole; rows have ``dim`` components, the missing ones 0, further ones left out."""
    ids, col = batch.column(0), batch.column(1)
    start, end = col.offsets[:-1].to_numpy(), col.offsets[1:].to_numpy()
    x = col.values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])  # a null is NaN here
    whole = np.flatnonzero(pc.and_(col.is_valid(), ids.is_valid()).to_numpy(zero_copy_only=False) & (bad[end] == bad[start]))
    at = start[whole, None] + np.arange(dim)
    there = at < end[whole, None]
    out = np.zeros((len(whole), dim))
    out[there] = np.floor(scale * x[at[there]])
    return ids.take(pa.array(whole)).to_numpy(zero_copy_only=False).astype(np.int64), out


def _matrix(vectors: list[np.ndarray], dim: int) -> np.ndarray:
    """Rows padded with zeros to ``dim`` components, which leaves inner products as they are over shared components."""
    m = np.zeros((len(vectors), dim))
    for k, v in enumerate(vectors):
        m[k, : len(v)] = v
    return m


def exact_topk(rows: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k best rows other than its own id, ties to smaller ids.

    Vectors that are null, hold a null or a non-finite component, or have a null id take no part, neither as
    queries nor as rows. Vectors of different lengths are compared over the components that both have. Fewer
    than k rows give all of them; an empty table gives an empty result. Rows that repeat an id are rows of
    their own (none of them answers a query of that id); a repeated query id is asked once, by its first
    vector in order. Integer inner products are exact below 2^53. Queries are taken in blocks of
    ``QUERY_BLOCK``, so that the broadcast has a fixed bound; all other columns are left unread.
    """
    spark = rows.sparkSession
    cols = [F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")]
    data, asked = rows.select(cols), queries.select(cols).where("id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    schema = "query_id long, rank int, vec_id long, score long"
    asked = stage(asked.groupBy("id").agg(F.min("v").alias("v")), "asked")
    result, after = None, None
    try:
        while True:
            block = asked if after is None else asked.where(F.col("id") > after)
            block = block.orderBy("id").limit(QUERY_BLOCK).collect()
            if not block:
                break
            after = block[-1]["id"]
            part = _block(data, block, k, scale)
            if len(block) == QUERY_BLOCK:  # others may follow: each is done before the next, so the plan does not grow
                part = stage(part, "topk")
            result = part if result is None else result.unionByName(part)
            if len(block) < QUERY_BLOCK:
                break
    finally:
        unstage(asked)
    return result if result is not None else spark.createDataFrame([], schema)


def _block(data: DataFrame, block: list, k: int, scale: int) -> DataFrame:
    spark = data.sparkSession
    qid = np.array([r["id"] for r in block], np.int64)
    vectors = [np.floor(scale * np.array(r["v"], np.float64)) for r in block]
    dim = max(map(len, vectors))
    queries = spark.sparkContext.broadcast((qid, _matrix(vectors, dim)))

    def scored(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores, queries down and rows across; a query's own rows score NaN."""
        ids, q = queries.value
        for b in batches:
            own, vec = quantized(b, scale, dim)
            for lo in range(0, len(own), ROWS):
                s = q @ vec[lo : lo + ROWS].T
                s[ids[:, None] == own[None, lo : lo + ROWS]] = np.nan
                yield own[lo : lo + ROWS], s

    def norms(batches):
        n, most = 0, 0.0
        for b in batches:
            own, vec = quantized(b, scale, dim)
            n += len(own)
            most = max(most, float(np.sqrt((vec * vec).sum(axis=1).max(initial=0))))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([most], pa.float64())], ["n", "most"])

    size = data.mapInArrow(norms, "n long, most double").agg(F.sum("n").alias("n"), F.max("most").alias("most")).first()
    if not size["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    reach = np.ceil(np.linalg.norm(queries.value[1], axis=1) * size["most"]) + 1
    low, width = -reach, np.ones(len(qid))
    while (low + width * BINS <= reach).any():
        width = np.where(low + width * BINS <= reach, width * 2, width)
    above = np.zeros(len(qid), np.int64)  # rows over the bins that are looked at

    def histogram(low, width, high):
        bounds = spark.sparkContext.broadcast((low, width, high))

        def fill(batches):
            lo, w, hi = bounds.value
            total = np.zeros(len(lo) * BINS, np.int64)
            for _, s in scored(batches):
                bin_ = np.floor((s - lo[:, None]) / w[:, None])
                ok = (s >= lo[:, None]) & (s < hi[:, None])
                total += np.bincount((np.arange(len(lo))[:, None] * BINS + np.where(ok, bin_, 0)).astype(np.int64)[ok], minlength=len(total))
            yield total

        return merged_counters(data, lambda batches: next(fill(batches)), len(low) * BINS, np.int64).reshape(len(low), BINS)

    high = low + width * BINS
    while True:
        counts = histogram(low, width, high)
        over = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]  # at or above each bin
        reached = over + above[:, None] >= k
        bin_ = np.where(reached.any(axis=1), BINS - 1 - reached[:, ::-1].argmax(axis=1), 0)  # the k-th score's bin, or the lowest
        above = above + np.where(bin_ + 1 < BINS, over[np.arange(len(bin_)), np.minimum(bin_ + 1, BINS - 1)], 0)
        low = low + bin_ * width
        high = low + width
        if (width <= 1).all():
            break
        width = np.maximum(1, np.ceil(width / BINS))
    kth = spark.sparkContext.broadcast((low, np.maximum(0, k - above)))

    def keep(batches):
        """What is above the k-th score, and a task's smallest ids among its ties."""
        ids, _ = queries.value
        at, need = kth.value
        ties: dict[int, np.ndarray] = {}
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        for own, s in scored(batches):
            q, r = np.nonzero(s > at[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(own[r]), pa.array(s[q, r].astype(np.int64))], schema=schema)
            for j in np.flatnonzero(((s == at[:, None]).any(axis=1)) & (need > 0)):
                same = own[s[j] == at[j]]
                ties[j] = np.sort(np.concatenate([ties[j], same]) if j in ties else same)[: need[j]]
        for j, same in ties.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(same), ids[j])), pa.array(same), pa.array(np.full(len(same), int(at[j])))], schema=schema)

    found = data.mapInArrow(keep, T.StructType([T.StructField(x, T.LongType()) for x in ("query_id", "vec_id", "score")]))
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("r", "b")).select("query_id", (F.col("r") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))
