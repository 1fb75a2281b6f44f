"""Approximate nearest neighbours with a hash-prefix forest.

Rows are dealt by a hash of their id to blocks of about ``block_rows``. In a block, every tree is a sorted array of long
hash strings: signs of random projections about the block's mean. A batch of queries meets each block once: it descends
to the longest matching prefix of every tree, then all trees ascend together, one bit at a time, until they hold
``share`` of the block as candidates (counted over trees). Candidates are ranked by their exact distance in double
precision; the k best of each block are merged. No distance is estimated and no prefix group is cut.

Nulls and ties: vectors that are null, zero, or hold null or non-finite components take no part; vectors meet only
vectors of their own length. A row is no neighbour of a query with its own id. Equal distances go to the smaller id;
rows repeated in full count once each. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREES = 16
BITS = 24
SHARE = 1.5
BLOCK_ROWS = 8192
QUERY_BLOCK = 65536
CHUNK = 128


def usable(column: str):
    """Whether a vector takes part."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


class Forest:
    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 11):
        self.bits = bits
        self.planes = np.random.default_rng(seed).normal(size=(trees, bits, vectors.shape[1]))
        self.mean = vectors.mean(axis=0)
        hashes = self.strings(vectors)
        self.order = np.argsort(hashes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(hashes, self.order, axis=1)

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        weights = 1 << np.arange(self.bits, dtype=np.int64)[::-1]
        centred = vectors - self.mean
        return np.stack([((centred @ p.T) > 0) @ weights for p in self.planes])

    def ranges(self, queries: np.ndarray, wanted: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 places in each tree (trees x queries) after the synchronous ascent.

        The trees stop when they hold ``wanted`` candidates, counted over trees, and one of them holds ``least`` by itself.
        """
        found = self.strings(queries)
        low = np.zeros(found.shape, np.int64)
        high = np.full(found.shape, self.sorted.shape[1], np.int64)
        open_ = np.arange(found.shape[1])
        for shift in range(self.bits):
            if not len(open_):
                break
            first = found[:, open_] >> shift << shift
            a = np.stack([np.searchsorted(s, f) for s, f in zip(self.sorted, first)])
            b = np.stack([np.searchsorted(s, f + (1 << shift)) for s, f in zip(self.sorted, first)])
            done = ((b - a).sum(axis=0) >= wanted) & ((b - a).max(axis=0) >= least)
            low[:, open_[done]], high[:, open_[done]] = a[:, done], b[:, done]
            open_ = open_[~done]
        return low, high


def nearest_in_block(ids, vectors, query_ids, queries, k: int, trees: int, bits: int, share: float):
    """(query id, id, distance) of the k nearest candidates of each query."""
    forest = Forest(vectors, trees, bits)
    norms = np.einsum("ij,ij->i", vectors, vectors)
    for start in range(0, len(queries), CHUNK):
        q, qid = queries[start:start + CHUNK], query_ids[start:start + CHUNK]
        low, high = forest.ranges(q, share * len(ids), min(k + 1, len(ids)))
        rough = norms - 2 * q @ vectors.T
        for j in range(len(q)):
            candidate = np.zeros(len(ids), bool)
            for t in range(trees):
                candidate[forest.order[t, low[t, j]:high[t, j]]] = True
            candidate &= ids != qid[j]
            at = np.flatnonzero(candidate)
            if len(at) > k:  # rounding of the rough distance cannot hide a neighbour within this margin
                d = rough[j, at]
                at = at[d <= np.partition(d, k - 1)[k - 1] + 1e-9 * (1 + abs(norms).max() + q[j] @ q[j])]
            exact = np.sqrt(((vectors[at] - q[j]) ** 2).sum(axis=1))
            best = np.lexsort((ids[at], exact))[:k]
            yield np.full(len(best), qid[j]), ids[at][best], exact[best]


def _matrix(table: pa.Table, column: str, dim: int) -> np.ndarray:
    flat = table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dim)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, trees: int = TREES, bits: int = BITS, share: float = SHARE,
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest of ``vectors`` (vec_id, embedding) to every query (same columns)."""
    rows = vectors.where(F.col("vec_id").isNotNull() & usable("embedding")).select("vec_id", "embedding")
    asked = queries.where(F.col("vec_id").isNotNull() & usable("embedding")).select(F.col("vec_id").alias("query_id"), "embedding")
    blocks = max(1, -(-vectors.count() // block_rows))
    groups = max(1, -(-queries.count() // QUERY_BLOCK))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
                       spread(groups).alias("part"), "vec_id", "embedding")
    right = asked.select(F.size("embedding").alias("dim"), spread(blocks).alias("block"),
                         F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("part"), "query_id", "embedding")

    def match(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        dim = a.column("dim")[0].as_py()
        found = list(nearest_in_block(a.column("vec_id").to_numpy().astype(np.int64), _matrix(a, "embedding", dim),
                                      b.column("query_id").to_numpy().astype(np.int64), _matrix(b, "embedding", dim),
                                      k, trees, bits, share))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found)], names=names)

    keys = ["dim", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(match, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
