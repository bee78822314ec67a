"""Nearest neighbours by a hash-prefix forest.

A shard is a bounded run of index vectors.  Each of its trees gives every
vector a long bit string (signs of random projections, centred on the shard's
mean) and keeps the strings sorted.  A query descends each tree to the longest
prefix that it shares with any string; then all trees ascend together, a bit
at a time, until the shared prefixes cover enough distinct vectors.  What they cover is
ranked by exact distance.  Queries travel to the shards in blocks of bounded
size; only each task's best k per query are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


@dataclass(frozen=True)
class Settings:
    trees: int = 64
    bits: int = 48
    #: Share of a shard that the prefixes of a query cover before ascent ends, each vector counted once, and the least number.
    cover: float = 0.6
    least: int = 400
    shard: int = 16_384
    #: Queries that travel together.
    block: int = 50_000
    seed: int = 7


class Forest:
    """Sorted hash strings of one shard's vectors."""

    def __init__(self, vectors: np.ndarray, s: Settings):
        self.x, self.s = vectors, s
        self.mean = vectors.mean(axis=0)
        self.planes = np.random.default_rng(s.seed).standard_normal((vectors.shape[1], s.trees * s.bits))
        keys = self._keys(vectors)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=1)

    def _keys(self, v: np.ndarray) -> np.ndarray:
        """A row per tree; the first projection is the highest bit."""
        s = self.s
        out = np.empty((s.trees, len(v)), dtype=np.uint64)
        value = np.uint64(1) << np.arange(s.bits - 1, -1, -1, dtype=np.uint64)
        for at in range(0, len(v), 4096):
            up = (v[at : at + 4096] - self.mean) @ self.planes > 0
            out[:, at : at + 4096] = (up.reshape(-1, s.trees, s.bits) * value).sum(axis=2, dtype=np.uint64).T
        return out

    def candidates(self, queries: np.ndarray, own: list[np.ndarray], k: int) -> Iterator[np.ndarray]:
        """Row numbers of candidates of each query: more than k, if there are, besides its `own` rows, which are left out."""
        s, n = self.s, len(self.x)
        keys = self._keys(queries)
        want = min(max(s.least, int(s.cover * n)), n)
        lo = np.zeros((s.bits + 1, s.trees, len(queries)), dtype=np.int32)
        hi = np.full_like(lo, n)
        for t in range(s.trees):
            alive = np.arange(len(queries))
            for depth in range(1, s.bits + 1):  # descent, to the longest shared prefix
                low = np.uint64((1 << (s.bits - depth)) - 1)
                first = keys[t, alive] & ~low
                a = np.searchsorted(self.keys[t], first)
                b = np.searchsorted(self.keys[t], first | low, side="right")
                lo[depth, t, alive], hi[depth, t, alive] = a, b
                gone = np.setdiff1d(np.arange(len(queries)), alive[b > a], assume_unique=True)
                lo[depth, t, gone] = hi[depth, t, gone] = 0
                alive = alive[b > a]
                if not len(alive):
                    lo[depth + 1 :, t] = hi[depth + 1 :, t] = 0
                    break
        covered = (hi - lo).sum(axis=1, dtype=np.int64)  # by depth and query; falls with depth
        depth = (covered >= want).sum(axis=0) - 1  # below, the trees together cannot cover enough distinct vectors
        for q in range(len(queries)):
            seen = np.zeros(n, dtype=bool)
            for d in range(max(0, int(depth[q])), -1, -1):  # synchronous ascent; depth 0 is the whole shard
                for a, b, order in zip(lo[d, :, q].tolist(), hi[d, :, q].tolist(), self.order, strict=True):
                    seen[order[a:b]] = True
                distinct = np.count_nonzero(seen)
                if distinct >= want and distinct - np.count_nonzero(seen[own[q]]) > k:
                    break
            seen[own[q]] = False
            yield np.flatnonzero(seen)


def _best(ids: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) > 4 * k:
        near = dist <= np.partition(dist, k - 1)[k - 1]
        ids, dist = ids[near], dist[near]
    at = np.lexsort((ids, dist))[:k]
    return ids[at], dist[at]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and v array<double> of the rows that take part: no null id, vector or component, no non-finite component, not all zero."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast(ArrayType(DoubleType())).alias("v"))
        .where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
        .where(~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))
    )


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, s: Settings = Settings()) -> DataFrame:
    """Each query's k nearest vectors by Euclidean distance in double precision, found through the forest.

    Both frames: id bigint, v array<double>, as from usable().  A query's own
    id is no candidate.  Vectors of another length than a query's aren't either.
    Returns query_id, rank, vec_id, score; ties go to the smaller id; repeated
    ids are candidates each.  A query without candidates has no rows.
    """
    spark = vectors.sparkSession
    n = queries.count()
    found = None
    # a block is bounded, whatever the number of queries
    blocks = max(1, -(-n // s.block))
    for b in range(blocks):
        mine = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        rows = mine.toArrow()
        ids = rows.column("id").to_numpy()
        v = rows.column("v").combine_chunks()
        sent = spark.sparkContext.broadcast((ids, v.values.to_numpy().astype(np.float64) if len(v) else np.zeros(0), v.offsets.to_numpy()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qid, flat, at = sent.value
            size = np.diff(at)
            groups = [(int(d), np.flatnonzero(size == d), flat[np.repeat(size == d, size)].reshape(-1, int(d))) for d in np.unique(size)]
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

            def shard(vid: np.ndarray, x: np.ndarray) -> None:
                for d, who, q in groups:
                    if d != x.shape[1]:
                        continue
                    forest = Forest(x, s)
                    by_id = np.argsort(vid, kind="stable")
                    mine = vid[by_id]
                    for at in range(0, len(q), 512):
                        some = qid[who[at : at + 512]]
                        own = [by_id[a:b] for a, b in zip(np.searchsorted(mine, some), np.searchsorted(mine, some, side="right"), strict=True)]
                        for i, rows in enumerate(forest.candidates(q[at : at + 512], own, k)):
                            j = int(who[at + i])
                            near = _best(vid[rows], np.sqrt(((x[rows] - q[at + i]) ** 2).sum(axis=1)), k)
                            if j in best:
                                near = _best(np.concatenate([best[j][0], near[0]]), np.concatenate([best[j][1], near[1]]), k)
                            best[j] = near

            held: dict[int, tuple[list, list]] = {}
            for batch in batches:
                vec = batch.column(1)
                off, values = vec.offsets.to_numpy(), vec.values.to_numpy()
                n = np.diff(off)
                for d in np.unique(n):
                    pick = np.flatnonzero(n == d)
                    x = values[(off[pick][:, None] + np.arange(d))]
                    a, c = held.setdefault(int(d), ([], []))
                    a.append(batch.column(0).to_numpy()[pick]), c.append(x)
                    if sum(map(len, a)) >= s.shard:
                        shard(np.concatenate(a), np.concatenate(c))
                        del held[int(d)]
            for a, c in held.values():
                shard(np.concatenate(a), np.concatenate(c))
            for j, (vid, dist) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vid), qid[j])), pa.array(vid), pa.array(dist)], ["query_id", "vec_id", "score"])

        part = vectors.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
