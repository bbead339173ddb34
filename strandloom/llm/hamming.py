"""Exact Hamming top-k over binary codes by incremental multi-index hashing.

A code of B bits is cut into m segments, each indexed by its value. A code at distance D
or less from a query differs by at most D // m bits in some segment, so after segments
0..j were searched up to radius s and the others up to s - 1, every code at distance
``m * s + j`` or less has been seen. The search grows segment by segment until the k-th
verified distance is within that proof.

Codes are dealt to tiles by id hash (see ``tiles``); each tile indexes its own block,
where equal codes are one entry with its k + 1 smallest ids (more can't be in any
result), and returns at most k + 1 rows a query. Segments have about log2(entries) bits.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandloom.llm.common import cut, table
from strandloom.llm.tiles import dealt, finite_vectors


@lru_cache(maxsize=512)
def _flips(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(width), radius)], np.int64)


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits packed to uint64 words."""
    pad = -bits.shape[1] % 64
    packed = np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64)


#: Signs in a word of a shuffled code.
PACKED = 63


def unpacked(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    """``(rows, dim)`` bits of codes that were packed to words of ``PACKED`` signs; the last word holds the rest."""
    words = col.combine_chunks().flatten().to_numpy().reshape(-1, -(-dim // PACKED))
    bits = np.unpackbits(np.ascontiguousarray(words[:, :, None].astype(">i8")).view(np.uint8), axis=2)
    last = dim - PACKED * (words.shape[1] - 1)
    return np.concatenate([*(bits[:, i, 64 - PACKED :] for i in range(words.shape[1] - 1)), bits[:, -1, 64 - last :]], axis=1)


class MultiIndex:
    def __init__(self, bits: np.ndarray, count: np.ndarray):
        """``bits``: distinct codes; ``count``: how many results each may give."""
        n, self.width = bits.shape
        self.count, self.words = count, _words(bits)
        parts = max(1, round(self.width / max(4, min(20, math.log2(max(n, 2))))))
        self.cuts = [self.width * i // parts for i in range(parts + 1)]
        self.starts, self.order = [], []
        for v, w in zip(self.segments(bits), self.widths, strict=True):
            self.order.append(np.argsort(v, kind="stable"))
            self.starts.append(np.concatenate(([0], np.cumsum(np.bincount(v, minlength=1 << w)))))

    @property
    def widths(self) -> list[int]:
        return [b - a for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def segments(self, bits: np.ndarray) -> list[np.ndarray]:
        return [bits[:, a:b].astype(np.int64) @ (1 << np.arange(b - a)) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def search(self, bits: np.ndarray, want: int, block: int = 64) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query code all entries up to the distance that holds ``want`` results: (entries, distances)."""
        out = []
        for at in range(0, len(bits), block):
            out += self._search(bits[at : at + block], want)
        return out

    def _search(self, bits: np.ndarray, want: int):
        n, total = len(bits), len(self.words)
        words, values, m = _words(bits), self.segments(bits), len(self.widths)
        seen = np.zeros((n, total), bool)
        held = np.zeros((n, self.width + 1), np.int64)  # verified results by distance
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        reach = np.full(n, -1)
        active = np.arange(n)
        for s in range(max(self.widths) + 1):
            for j, w in enumerate(self.widths):
                if s <= w and len(active):
                    probe = values[j][active][:, None] ^ _flips(w, s)[None, :]
                    low, size = self.starts[j][probe], self.starts[j][probe + 1] - self.starts[j][probe]
                    some = np.nonzero(size)
                    size, low, q = size[some], low[some], active[some[0]]
                    if len(size):
                        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                        entry, q = self.order[j][np.repeat(low, size) + step], np.repeat(q, size)
                        new = ~seen[q, entry]
                        entry, q = entry[new], q[new]
                        seen[q, entry] = True  # a segment value holds an entry once, so no pair comes twice in one probe
                        far = np.bitwise_count(self.words[entry] ^ words[q]).sum(axis=1).astype(np.int64)
                        np.add.at(held, (q, far), self.count[entry])
                        hits.append((q, entry, far))
                proof = min(self.width, m * s + j)
                within = held[active, : proof + 1].cumsum(axis=1)
                done = within[:, -1] >= want
                if done.any():
                    reach[active[done]] = (within[done] >= want).argmax(axis=1)
                    active = active[~done]
            if not len(active):
                break
        reach[active] = self.width  # fewer entries than wanted: all of them
        if not hits:
            return [(np.zeros(0, np.int64),) * 2] * n
        q, entry, far = (np.concatenate(x) for x in zip(*hits, strict=True))
        keep = far <= reach[q]
        q, entry, far = q[keep], entry[keep], far[keep]
        order = np.argsort(q, kind="stable")
        q, entry, far = q[order], entry[order], far[order]
        ends = np.searchsorted(q, np.arange(n + 1))
        return [(entry[a:b], far[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def tile_top(qid: np.ndarray, qbits: np.ndarray, cid: np.ndarray, cbits: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, row id, distance): the k nearest rows of the block for each query, its own row left out."""
    codes, inverse = np.unique(cbits, axis=0, return_inverse=True)
    inverse = inverse.reshape(-1)
    by = np.lexsort((cid, inverse))
    first = np.searchsorted(inverse[by], np.arange(len(codes) + 1))
    count = np.minimum(np.diff(first), k + 1)
    asked, own = np.unique(qbits, axis=0, return_inverse=True)
    own = own.reshape(-1)
    out = []
    found = MultiIndex(codes, count).search(asked, k + 1)
    best = []
    for entry, far in found:
        n = count[entry]
        ids = np.concatenate([cid[by[first[e] : first[e] + c]] for e, c in zip(entry, n, strict=True)]) if len(entry) else np.zeros(0, np.int64)
        d = np.repeat(far, n)
        order = np.lexsort((ids, d))[: k + 1]
        best.append((ids[order].tolist(), d[order].tolist()))
    for i, a in zip(qid.tolist(), own.tolist(), strict=True):
        out += [(i, x, d) for x, d in zip(*best[a], strict=True) if x != i][:k]
    return out


def hamming_top(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", row_block: int | None = None, query_block: int | None = None) -> DataFrame:
    """The k rows at the smallest Hamming distance of sign codes (bit i: component i is positive) for each row whose id is divisible by ``every``.

    Returns ``(query_id, rank, vec_id, distance)``; ties go to the smaller id. Rows with a null id or without a sound vector take no
    part; codes of another length are no candidates; repeated rows count once, different codes under one id each count; a query with fewer candidates gets all; an
    empty table gives no rows.
    """
    # 63 signs a word, the first component highest
    bit = lambda word, x: F.shiftleft(word, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    words = F.transform(F.sequence(F.lit(0), F.floor((F.size("vec") - 1) / PACKED).cast("int")), lambda i: F.aggregate(F.slice("vec", i * PACKED + 1, PACKED), F.lit(0).cast("long"), bit))
    rows = finite_vectors(df, id_col, vec_col).select("id", words.alias("code"), "dim")
    rows = cut(rows.dropDuplicates(["id", "code", "dim"]))
    r, q = dealt(rows, lambda dim: dim, every, row_block, query_block)

    def tile(left, right):
        out = []
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            sides = [(t.column("id").to_numpy(), unpacked(t.column("code"), dim)) for t in (right, left)]
            out = tile_top(*sides[0], *sides[1], k)
        a, b, d = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "distance": pa.array(d, pa.int32())})

    keys = ["dim", "rb", "qb"]
    found = r.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(tile, "query_id long, vec_id long, distance int")
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def op2_hamming(spark, sf_dir):
    return hamming_top(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, 1 + len(q.b)), lambda i: CAST(q.b[i] <> c.b[i] AS INTEGER))) AS INTEGER) AS distance
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.b) = len(q.b))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance
FROM s QUALIFY rank <= 20
"""
