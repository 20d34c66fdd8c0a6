"""Operator 7: exact top-k inner products by KD-trees.

Vectors are dealt into shards of bounded size. A task reads a shard's vectors,
builds one KD-tree over them (median splits of the widest dimension, tight
boxes) and streams the shard's queries through it, batch by batch, by
best-first traversal: nodes leave a heap by their box-to-query bound, and a
query stops when the best bound left is below its kth score. The rounds search
one shard for each query, then ``MORE_SHARDS`` others, then the rest; the kth
score found so far goes along.

Every row with a usable vector is a candidate of every query row but itself,
also rows that share an id or have none; a query row answers for itself, so
rows that share a query id each get an answer. Ties go to the smaller id, null
ids last. Vectors that are null or hold null or non-finite components take no
part. Components beyond the long range saturate. Vectors are only compared
with vectors of the same length; empty ones score 0 with each other.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import prepare, staged

SHARD_ROWS, LEAF_ROWS, MORE_SHARDS = 8192, 128, 3


class KDTree:
    """Boxes and leaves of one shard."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.points, self.boxes_lo, self.boxes_hi, self.kids, self.leaves = points, [], [], [], []
        self._add(np.arange(len(points)), leaf_rows)
        self.lo, self.hi = np.array(self.boxes_lo), np.array(self.boxes_hi)

    def _add(self, rows: np.ndarray, leaf_rows: int) -> int:
        p = self.points[rows]
        lo, hi = p.min(axis=0), p.max(axis=0)
        me = len(self.kids)
        self.boxes_lo.append(lo)
        self.boxes_hi.append(hi)
        self.kids.append(None)
        self.leaves.append(None)
        axis = int(np.argmax(hi - lo)) if len(lo) else 0
        if len(rows) <= leaf_rows or not len(lo) or hi[axis] == lo[axis]:
            self.leaves[me] = rows
            return me
        order = rows[np.argpartition(p[:, axis], len(rows) // 2)]
        half = len(rows) // 2
        self.kids[me] = (self._add(order[:half], leaf_rows), self._add(order[half:], leaf_rows))
        return me

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Per query and node, the largest inner product a point of the box can have."""
        b = np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T
        return b + np.abs(b) * 1e-9   # covers rounding where sums exceed 2**53


def _leaf_scores(points: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (points @ query).astype(np.int64)
    big = points.astype(object) @ query.astype(object)
    return np.array([int(max(min(x, 2**63 - 1), -2**63)) for x in big], np.int64)


def search(tree: KDTree, rows: np.ndarray, order: np.ndarray, q_rows: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int):
    """Best-first traversal for each query; yields (query's number, places of
    points in the tree, scores) of the points that reach ``floors`` and the
    query's own kth score. ``rows`` tell points apart, ``order`` ranks ties."""
    peak = float(np.abs(tree.points).max(initial=0)) * float(np.abs(queries).max(initial=0)) * queries.shape[1]
    exact = peak < 2**53
    bounds = tree.bounds(queries)
    for i, q in enumerate(queries):
        kth, best_s, best_i = floors[i], np.zeros(0, np.int64), np.zeros(0, np.int64)
        heap = [(-bounds[i, 0], 0)]
        while heap and -heap[0][0] >= kth:
            _, node = heapq.heappop(heap)
            at = tree.leaves[node]
            if at is None:
                for kid in tree.kids[node]:
                    if bounds[i, kid] >= kth:
                        heapq.heappush(heap, (-bounds[i, kid], kid))
                continue
            s = _leaf_scores(tree.points[at], q, exact)
            take = (s >= kth) & (rows[at] != q_rows[i])
            if take.any():
                best_s, best_i = np.append(best_s, s[take]), np.append(best_i, at[take])
                o = np.lexsort((order[best_i], ~best_s))[:k]           # ~x falls as x rises, without overflow
                best_s, best_i = best_s[o], best_i[o]
                if len(best_s) == k:
                    kth = max(kth, best_s[-1])
        yield i, best_i, best_s


_FOUND = pa.schema([("q_row", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_FOUND_DDL = "q_row long, query_id long, row long, vec_id long, score long"


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), dim)


def _search_shards(k: int):
    """Rows by (dim, shard), vectors before queries -> what the queries find."""
    def run(batches):
        key, parts, tree, rows, ids, order = None, [], None, None, None, None
        for b in batches:
            dim, shard, is_query = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            cut = np.flatnonzero((dim[1:] != dim[:-1]) | (shard[1:] != shard[:-1]) | (is_query[1:] != is_query[:-1])) + 1
            for lo, hi in zip(np.r_[0, cut], np.r_[cut, b.num_rows]):
                part, d = b.slice(lo, hi - lo), int(dim[lo])
                if key != (d, int(shard[lo])):
                    key, parts, tree = (d, int(shard[lo])), [], None
                if not is_query[lo]:
                    parts.append(part)
                    continue
                if tree is None:
                    if not parts:
                        continue             # queries of a length that this shard has no vector of
                    t = pa.Table.from_batches(parts).combine_chunks()
                    ids = t["vec_id"].combine_chunks()
                    rows, none = t["row"].to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
                    order = np.empty(len(rows), np.int64)
                    order[np.lexsort((rows, ids.fill_null(0).to_numpy(zero_copy_only=False), none))] = np.arange(len(rows))
                    tree, parts = KDTree(_matrix(t["v"].combine_chunks(), d)), []
                q_rows = part.column("row").to_numpy()
                floors = part.column("kth").cast(pa.float64(), safe=False).fill_null(-math.inf).to_numpy(zero_copy_only=False)
                found = list(search(tree, rows, order, q_rows, _matrix(part.column("v"), d), floors, k))
                n = [len(s) for _, _, s in found]
                own = pa.array(np.repeat(np.arange(len(n)), n))
                at = np.concatenate([i for _, i, _ in found]) if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([
                    part.column("row").take(own), part.column("vec_id").take(own), pa.array(rows[at]), ids.take(pa.array(at)),
                    pa.array(np.concatenate([s for _, _, s in found]) if found else at)], schema=_FOUND)
    return run


def quantised(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """``(vec_id, v array<long>)``: floor(scale * x) of the usable vectors."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.where("embedding IS NOT NULL").where(ok).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))


def top_k(vectors: DataFrame, wanted: Column, k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``vectors(vec_id, v)``; the rows that ``wanted`` marks are the queries ->
    each query's ``k`` highest scores among the other rows: query_id, rank,
    vec_id, score."""
    prepare(vectors.sparkSession)
    vectors = staged(vectors.select("vec_id", "v", F.coalesce(wanted, F.lit(False)).alias("wanted"), F.size("v").alias("dim"))
                     .withColumn("row", F.monotonically_increasing_id()), "vectors")
    shards = max(1, math.ceil(vectors.count() / shard_rows))
    null = F.lit(None).cast("long").alias("kth")
    points = vectors.select("dim", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), F.lit(False).alias("is_query"), "row", "vec_id", "v", null)
    queries = vectors.where("wanted").withColumn("home", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(shards)))
    # the shards of a round, as steps from the query's first one
    cuts = sorted({0, 1, min(1 + MORE_SHARDS, shards), shards})
    found = None
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        q = queries.withColumn("kth", F.lit(None).cast("long"))
        if found is not None:
            best = W.partitionBy("q_row").orderBy(F.desc("score"))
            floor = found.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select(F.col("q_row").alias("row"), F.col("score").alias("kth"))
            q = queries.join(floor, "row", "left")
        steps = F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi - 1).cast("long")))
        q = q.withColumn("step", steps).select("dim", F.pmod(F.col("home") + F.col("step"), F.lit(shards)).alias("shard"), F.lit(True).alias("is_query"),
                                               "row", "vec_id", "v", "kth")
        new = points.unionByName(q).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "is_query") \
            .mapInArrow(_search_shards(k), _FOUND_DDL)
        new = staged(new, f"found-{i}")
        found = new if found is None else found.unionByName(new)
    order = W.partitionBy("q_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH ok AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id,
             coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
      FROM ok q JOIN ok c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
t AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM t WHERE rank <= 5
"""
