"""Nearest neighbours by a block matrix join over int8 tiles.

Each vector is rounded to int8 with its own scale. A tile's product of the two int8
blocks gives every inner product up to a proven error: with q', c' the rounded vectors,
``|q.c - q'.c'| <= |q||c - c'| + |q - q'||c'|``. A candidate survives if its upper bound
reaches the k-th largest lower bound of its block, and the best k found so far; survivors
are recomputed in double precision, added in order of components, and merged into a heap
for each query. Only k rows for each query leave a tile, and the final merge ranks them. The result is
exact: the bounds drop nothing that belongs to it.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandloom.llm.common import cut, table
from strandloom.llm.tiles import dealt, finite_vectors


def _matrix(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = col.combine_chunks().flatten() if isinstance(col, pa.ChunkedArray) else col.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of rows, without overflow below the largest double."""
    top = np.abs(x).max(axis=1, initial=0.0)
    top[top == 0] = 1.0
    with np.errstate(over="ignore"):
        return np.sqrt(((x / top[:, None]) ** 2).sum(axis=1)) * top


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, the norms of the rounded rows and of what rounding took away."""
    scale = np.abs(x).max(axis=1) / 127  # at most 1.5e306, so scaled rows never overflow
    scale[scale == 0] = np.finfo(np.float64).tiny  # a denormal maximum: all of the row is error
    whole = np.clip(np.rint(x / scale[:, None]), -127, 127)
    back = whole * scale[:, None]
    return whole.astype(np.int8), scale, norms(back), norms(x - back)


def inner(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added in order of components.

    Where a product or a partial sum overflows, the sum is taken of rows scaled by powers of two; it is infinite only if the result is, and never NaN.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.cumsum(rows * query, axis=1)[:, -1]
        bad = np.flatnonzero(~np.isfinite(out))
        if len(bad):
            up, own = np.frexp(np.abs(rows[bad]).max(axis=1))[1], int(np.frexp(np.abs(query).max())[1])
            scaled = np.cumsum(np.ldexp(rows[bad], -up[:, None]) * np.ldexp(query, -own), axis=1)[:, -1]
            out[bad] = np.ldexp(scaled, up + own)
    return out


def tile_top(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, rows: int = 4096, queries: int = 256) -> list[list[tuple[float, int]]]:
    """For each query its k best of the block as (-score, id), ascending."""
    exact32 = q.shape[1] * 127 * 127 < 1 << 24
    kind = np.float32 if exact32 else np.float64
    heaps: list[list[tuple[float, int]]] = [[] for _ in qid]
    c8, c_scale, c_norm, c_lost = rounded(c)
    q8, q_scale, _, q_lost = rounded(q)
    q_norm = norms(q)
    floor = np.full(len(qid), -np.inf)
    for at in range(0, len(cid), rows):
        cs = slice(at, at + rows)
        block = c8[cs].astype(kind).T
        for to in range(0, len(qid), queries):
            qs = slice(to, to + queries)
            with np.errstate(over="ignore", invalid="ignore"):
                near = (q8[qs].astype(kind) @ block).astype(np.float64) * q_scale[qs, None] * c_scale[None, cs]
                off = q_norm[qs, None] * c_lost[None, cs] + q_lost[qs, None] * c_norm[None, cs]
                off = off * (1 + 1e-9) + 1e-12 * (1 + q_norm[qs, None] * c_norm[None, cs])
                low, high = near - off, near + off
            # a bound that overflowed says nothing
            low[~np.isfinite(low)], high[~np.isfinite(high)] = -np.inf, np.inf
            own = qid[qs, None] == cid[None, cs]
            low[own] = -np.inf
            n = low.shape[1]
            kth = np.partition(low, n - k, axis=1)[:, n - k] if n >= k else np.full(low.shape[0], -np.inf)
            kth = np.maximum(kth, floor[qs])
            alive = (high >= kth[:, None]) & ~own
            for i in range(alive.shape[0]):
                hit = np.flatnonzero(alive[i])
                if not len(hit):
                    continue
                score = inner(c[at + hit], q[to + i])
                if len(hit) > k:  # only those that reach the k-th score, ties by id
                    reach = score >= np.partition(score, len(score) - k)[len(score) - k]
                    hit, score = hit[reach], score[reach]
                    order = np.lexsort((cid[at + hit], -score))[:k]
                    hit, score = hit[order], score[order]
                heap = heapq.nsmallest(k, [*heaps[to + i], *zip((-score).tolist(), cid[at + hit].tolist(), strict=True)])
                heaps[to + i] = heap
                if len(heap) == k:
                    floor[to + i] = -heap[-1][0]
    return heaps


def nearest(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", row_block: int | None = None, query_block: int | None = None) -> DataFrame:
    """The k rows of largest inner product for each row whose id is divisible by ``every``: ``(query_id, rank, vec_id, score)``.

    Defined results: rows without a sound vector (see ``finite_vectors``) or with a null id take no part; vectors of another
    dimension than the query's are no candidates; repeated rows count once, different vectors under one id each count; ties go to the smaller id; a
    query with fewer candidates gets all; a lone query gets none; an empty table gives no rows.
    """
    rows = cut(finite_vectors(df, id_col, vec_col))
    r, q = dealt(rows, lambda dim: 8 * dim, every, row_block, query_block)

    def tile(left, right):
        dim = left.column("dim")[0].as_py() if left.num_rows else 0
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            qid, cid = right.column("id").to_numpy(), left.column("id").to_numpy()
            for query, heap in zip(qid.tolist(), tile_top(qid, _matrix(right.column("vec"), dim), cid, _matrix(left.column("vec"), dim), k), strict=True):
                out += [(query, i, -s) for s, i in heap]
        a, b, s = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})

    keys = ["dim", "rb", "qb"]
    found = r.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(tile, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, 1 + len(q.v)), lambda i: q.v[i] * c.v[i])) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
