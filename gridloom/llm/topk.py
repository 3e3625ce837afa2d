"""Exact top-k search by columnar branch and bound.

Vectors become integers, floor(scale * x), and are dealt into blocks of candidates and blocks of queries; every block
of queries meets every block of candidates.  There, a block's values lie dimension by dimension.  A query's scores are
summed over ``STEP`` dimensions at a time for all candidates left; what the remaining dimensions can add is at most the
product of the remaining lengths, so candidates whose best possible score is below the k-th best sure score are compacted
away before the next step.  Each pair of blocks keeps k rows a query, and a window takes the best k of those.

The query set is a stated share of the table (ids divisible by ``every``), so work is a block product by design; blocks
bound what a task holds, and no side is broadcast.

Edge cases: vectors that are null or hold a null or non-finite value take no part, nor do rows without an id; shorter
vectors are taken as ending in zeros; of rows repeating an id the one with the least vector stands; fewer than k
candidates give fewer rows; ties go to the smaller id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K, SCALE, EVERY, STEP = 20, 64, 20, 16
CANDIDATES = (2048, 1 << 17)
QUERIES = 8192


def long(scores: np.ndarray) -> np.ndarray:
    """As 64-bit integers; scores outside their range become its ends."""
    return scores.astype(np.int64) if scores.dtype != object else np.array([min(max(x, -(2**63)), 2**63 - 1) for x in scores], np.int64)


def search(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query id, candidate id and score of the best k of each query; rows of ``candidates`` are dimensions."""
    dims, n = candidates.shape
    largest = max(np.abs(queries).max(initial=0), np.abs(candidates).max(initial=0))
    kind = np.float64 if float(largest) ** 2 * max(1, dims) < 2**52 else object  # exact either way
    q, x = queries.astype(kind), np.ascontiguousarray(candidates.astype(kind))
    cuts = [*range(0, dims, STEP), dims] if dims else [0]
    far = lambda v, axis: [np.sqrt((v[tuple(slice(None) if a != axis else slice(c, None) for a in range(2))].astype(float) ** 2).sum(axis=axis)) * (1 + 1e-9) for c in cuts[1:]]
    q_left, x_left = far(q, 1), far(x, 0)
    found = []
    for begin in range(0, len(q), 32):
        block = q[begin : begin + 32]
        first = block[:, : cuts[1]] @ x[: cuts[1]] if dims else np.zeros((len(block), n))
        for i in range(len(block)):
            at, score = np.flatnonzero(ids != query_ids[begin + i]), None
            score = first[i][at]
            for step in range(1, len(cuts)):
                if len(at) > k and step < len(cuts) - 1:
                    slack = q_left[step - 1][begin + i] * x_left[step - 1][at] + 1e-6
                    sure = np.partition((score - slack).astype(float), len(at) - k)[len(at) - k]
                    left = np.flatnonzero((score + slack).astype(float) >= sure)
                    at, score = at[left], score[left]
                if step < len(cuts) - 1:
                    score = score + block[i, cuts[step] : cuts[step + 1]] @ x[cuts[step] : cuts[step + 1]][:, at]
            best = np.lexsort((ids[at], -score))[:k]
            found.append((np.full(len(best), query_ids[begin + i]), ids[at[best]], long(score[best])))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def top_k(df: DataFrame, k: int = K, scale: int = SCALE, every: int = EVERY, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k rows with the largest inner products for each query."""
    limit = float("inf")
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    rows = df.where(good & F.col(vec_id).isNotNull()).groupBy(F.col(vec_id).cast("long").alias("vec_id")).agg(F.min(vector).alias("v"))
    rows = rows.select("vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    n = df.count()
    size = min(max(CANDIDATES[0], math.ceil(n / 24)), CANDIDATES[1])
    blocks, asking = max(1, math.ceil(n / size)), max(1, math.ceil(n / every / QUERIES))
    hashed = F.xxhash64("vec_id")
    everyone = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    candidates = rows.select("vec_id", "v", F.pmod(hashed, F.lit(blocks)).cast("int").alias("block"), everyone(asking).alias("ask"))
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v", everyone(blocks).alias("block"), F.pmod(hashed, F.lit(asking)).cast("int").alias("ask"))

    def matrix(table: pa.Table, dims: int) -> np.ndarray:
        lists = table.column("v").combine_chunks()
        sizes, out = np.diff(np.asarray(lists.offsets)), np.zeros((len(lists), dims), np.int64)
        flat = np.asarray(lists.flatten())
        out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        return out

    def meet(some: pa.Table, asked: pa.Table) -> pa.Table:
        if not some.num_rows or not asked.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        dims = max(int(np.diff(np.asarray(t.column("v").combine_chunks().offsets)).max()) for t in (some, asked))
        got = search(matrix(asked, dims), np.asarray(asked.column("vec_id")), matrix(some, dims).T, np.asarray(some.column("vec_id")), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, got), strict=True)))

    pairs = candidates.groupBy("block", "ask").cogroup(queries.groupBy("block", "ask")).applyInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
with v as (
  select vec_id, list_transform(min(embedding), lambda x: floor(64 * x::double)) as v from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  group by vec_id
), scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 20
"""
