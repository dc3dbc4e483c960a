"""Approximate nearest neighbours by collision counting over single projections.

Vectors are laid out in shards of about ``SHARD_ROWS``; queries go to every
shard in blocks of about ``QUERY_BLOCK``, so a task holds one of each.  A
shard's index is one sorted array per random projection.  Around a query's
projections, windows grow step by step (virtual rehashing: the same arrays at
a wider radius); a vector that lies in at least ``THRESHOLD`` of the windows
has collided often enough and is a candidate.  Windows grow until the
candidates are five times the wanted ones plus a share of the shard; candidates are then
verified by their exact inner product.  The best of each shard are merged.

The share starts at ``SHARE``.  How much is enough hangs on dimension and spread,
so each task measures the recall of ``PROBES`` of its queries against all vectors
of its shard and doubles the share until ``RECALL`` is reached (the whole shard at most).

Largest inner product becomes least distance by one more coordinate that
brings all vectors to the length of the longest.  Every row is indexed; only the
share hangs on a sample of the queries.

Defined cases: vectors null, empty, zero or with null or non-finite parts, and
rows without vec_id, take no part; of repeated vec_ids the smallest vector
counts; a query meets only vectors of its own dimension.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 20
PROJECTIONS = 64
THRESHOLD = 38
SHARE = 0.18
RECALL = 0.92
PROBES = 32
SHARD_ROWS = 4096
QUERY_BLOCK = 2048
FIRST, STEP, RADII = 0.8, 1.25, 14  # the windows' first radius, their growth, and how many there are
SEED = 20_240_603


def usable(vector: Column) -> Column:
    """Not null, some part not zero, all parts finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


class ShardIndex:
    """Sorted projections of one shard's vectors, brought to length 1."""

    def __init__(self, vectors: np.ndarray, longest: float):
        unit = vectors / longest
        rest = np.sqrt(np.maximum(1.0 - (unit * unit).sum(1), 0.0))
        self.axes = np.random.Generator(np.random.PCG64(SEED)).standard_normal((PROJECTIONS, vectors.shape[1] + 1))
        places = np.ascontiguousarray((np.hstack((unit, rest[:, None])) @ self.axes.T).T)
        self.order = np.argsort(places, axis=1, kind="stable")
        self.sorted = np.take_along_axis(places, self.order, axis=1)
        self.vectors = vectors

    def windows(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last places of each query's window, by radius and projection; the last radius holds all."""
        centres = self.axes[:, :-1] @ (queries / np.sqrt((queries * queries).sum(1))[:, None]).T
        radii = [*(FIRST * STEP ** np.arange(RADII - 1)), np.inf]
        lo, hi = np.empty((2, RADII, *centres.shape), np.int32)
        for r, radius in enumerate(radii):
            for j, row in enumerate(self.sorted):
                lo[r, j] = np.searchsorted(row, centres[j] - radius)
                hi[r, j] = np.searchsorted(row, centres[j] + radius, "right")
        return lo, hi

    def candidates(self, lo: np.ndarray, hi: np.ndarray, wanted: int) -> np.ndarray:
        """Vectors in enough of one query's windows, at the first radius at which they are ``wanted``."""
        n = len(self.vectors)
        if wanted >= n:
            return np.arange(n)
        hits = None
        for r in range(RADII):
            if r == 0:
                rings = [row[a:b] for row, a, b in zip(self.order, lo[0].tolist(), hi[0].tolist(), strict=True)]
            else:  # what a window has grown by
                rings = [row[a:b] for row, a, b in zip(self.order, lo[r].tolist(), lo[r - 1].tolist(), strict=True)]
                rings += [row[a:b] for row, a, b in zip(self.order, hi[r - 1].tolist(), hi[r].tolist(), strict=True)]
            more = np.bincount(np.concatenate(rings), minlength=n)
            hits = more if hits is None else hits + more
            found = np.flatnonzero(hits >= THRESHOLD)
            if len(found) >= wanted:
                break
        return found


def enough_candidates(index: ShardIndex, queries: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, share: float) -> int:
    """How many candidates of the shard find ``RECALL`` of the ``k`` nearest, measured on ``PROBES`` of the queries."""
    n = len(index.vectors)
    probes = np.unique(np.linspace(0, len(queries) - 1, PROBES).astype(np.int64))
    scores = queries[probes] @ index.vectors.T
    nearest = np.argpartition(-scores, min(k, n) - 1, axis=1)[:, :k]
    while share < 1.0:
        wanted = 5 * k + int(share * n)
        found = sum(np.isin(near, index.candidates(lo[:, :, i], hi[:, :, i], wanted)).sum()
                    for i, near in zip(probes.tolist(), nearest, strict=True))
        if wanted >= n or found >= RECALL * nearest.size:
            return wanted
        share *= 2
    return n


def _search(k: int, share: float, longest: float):
    names = ["query_id", "vec_id", "score"]

    def run(shard: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if shard.num_rows and queries.num_rows:
            matrix = lambda t: np.array(t.column("vector").combine_chunks().flatten(), dtype=np.float64).reshape(t.num_rows, -1)
            ids, vectors = shard.column("vec_id").to_numpy(), matrix(shard)
            by_id = np.argsort(ids, kind="stable")
            ids, index = ids[by_id], ShardIndex(vectors[by_id], longest)
            asked = matrix(queries)
            lo, hi = index.windows(asked)
            wanted = enough_candidates(index, asked, lo, hi, k, share)
            for i, (q, vector) in enumerate(zip(queries.column("vec_id").to_numpy(), asked, strict=True)):
                at = index.candidates(lo[:, :, i], hi[:, :, i], wanted)
                at = at[ids[at] != q]
                near = index.vectors[at]
                if len(at) > k:  # a quick product first; whatever it puts near the k-th is then summed in one way for all
                    quick = near @ vector
                    kth = np.partition(quick, len(at) - k)[len(at) - k]
                    hold = quick >= kth - 1e-9 * max(1.0, float(np.abs(quick).max()))
                    at, near = at[hold], near[hold]
                score = (near * vector).sum(1)
                best = np.lexsort((ids[at], -score))[:k]
                out_q.append(np.full(len(best), q))
                out_v.append(ids[at][best])
                out_s.append(score[best])
        return pa.table([pa.array(np.concatenate(x)) for x in (out_q, out_v, out_s)], names=names)

    return run


def nearest(embeddings: DataFrame, query_every: int, k: int = K, vec_id: str = "vec_id", vector: str = "embedding",
            share: float = SHARE, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` found nearest of each row whose id ``query_every`` divides."""
    v = embeddings.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("vector")) \
        .where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    v = v.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    seen = v.agg(F.count("*").alias("n"), F.sum((F.col("vec_id") % query_every == 0).cast("int")).alias("q"),
                 F.max(F.sqrt(square)).alias("longest")).first()
    shards, blocks = -(-(seen["n"] or 0) // shard_rows) or 1, -(-(seen["q"] or 0) // query_block) or 1
    part = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = v.select("vec_id", "vector", "dim", part(1, shards).alias("shard"), all_of(blocks).alias("block"))
    queries = v.where(F.col("vec_id") % query_every == 0).select(
        "vec_id", "vector", "dim", part(2, blocks).alias("block"), all_of(shards).alias("shard"))
    keys = ["shard", "block", "dim"]
    found = rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(
        _search(k, share, float(seen["longest"] or 1.0)), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def neighbour_report(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, 20)
