import random

from fractions import Fraction

import numpy as np
import pytest

from strandloom.llm import hamming, nearest, tiles


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")


def vectors(n, dim, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)).astype(np.float32)
    x[n // 2 : n // 2 + n // 4] = x[0]  # a hot vector
    return x


def odd_rows(dim):
    nan, inf = float("nan"), float("inf")
    return [(1000, None), (1020, [0.0] * dim), (1040, [nan] + [1.0] * (dim - 1)), (1060, [None] + [1.0] * (dim - 1)), (1080, [inf] * dim), (None, [1.0] * dim), (1100, [1.0, 2.0]), (1101, [3.0, -1.0]), (2000, [5.0]), (1120, [])]


@pytest.mark.parametrize(("dim", "blocks"), [(16, (None, None)), (7, (50, 3)), (64, (64, 4))])
def test_nearest_is_exact(spark, dim, blocks):
    x = vectors(240, dim, dim)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(i, v, 1) for i, v in odd_rows(dim)] + [(5, x[5].tolist(), 2)]
    got = {}
    for r in nearest.nearest(table(spark, rows), k=12, row_block=blocks[0], query_block=blocks[1]).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    wide = x.astype(np.float64)
    for q in range(0, 240, 20):
        score = np.cumsum(wide * wide[q], axis=1)[:, -1]
        want = sorted((-s, i) for i, s in enumerate(score.tolist()) if i != q)[:12]
        assert sorted(got.pop(q)) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
    assert sorted(got.pop(1100)) == [(1, 1101, 1.0)]
    assert got == {}
    assert nearest.nearest(table(spark, rows).limit(0)).count() == 0


def test_error_bounds_hold():
    r = np.random.default_rng(1)
    for scale in (1e-30, 1.0, 1e20):
        q, c = r.normal(size=(20, 9)) * scale, r.normal(size=(40, 9)) * 10.0 ** r.integers(-6, 6, (40, 1))
        q8, qs, _, ql = nearest.rounded(q)
        c8, cs, cn, cl = nearest.rounded(c)
        near = (q8.astype(float) @ c8.T.astype(float)) * qs[:, None] * cs
        off = np.linalg.norm(q, axis=1)[:, None] * cl + ql[:, None] * cn
        assert (np.abs(q @ c.T - near) <= off * (1 + 1e-9) + 1e-12 * (1 + np.linalg.norm(q, axis=1)[:, None] * cn)).all()


@pytest.mark.parametrize(("dim", "blocks"), [(64, (None, None)), (13, (50, 3)), (100, (90, 5))])
def test_hamming_is_exact(spark, dim, blocks):
    x = vectors(240, dim, dim + 1)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(i, v, 1) for i, v in odd_rows(dim)] + [(5, x[5].tolist(), 2)]
    got = {}
    for r in hamming.hamming_top(table(spark, rows), k=12, row_block=blocks[0], query_block=blocks[1]).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.distance))
    bits = x > 0
    for q in range(0, 240, 20):
        want = sorted((int((bits[i] != bits[q]).sum()), i) for i in range(240) if i != q)[:12]
        assert sorted(got.pop(q)) == [(n + 1, i, d) for n, (d, i) in enumerate(want)]
    assert sorted(got.pop(1100)) == [(1, 1101, 1)]
    assert got == {}
    assert hamming.hamming_top(table(spark, rows).limit(0)).count() == 0


def test_index_stops_at_the_proof():
    r = np.random.default_rng(3)
    bits = (r.random((3000, 48)) < 0.5).astype(np.uint8)
    bits = np.unique(bits, axis=0)
    index = hamming.MultiIndex(bits, np.ones(len(bits), np.int64))
    query = bits[random.Random(1).sample(range(len(bits)), 9)] ^ (r.random((9, 48)) < 0.05)
    for (entry, far), q in zip(index.search(query.astype(np.uint8), 10), query, strict=True):
        all_ = (bits != q).sum(axis=1)
        reach = np.sort(all_)[9]
        assert sorted(entry.tolist()) == np.flatnonzero(all_ <= reach).tolist()
        assert (all_[entry] == far).all()


def test_neighbours_of_huge_vectors():
    r = np.random.default_rng(4)
    c = np.vstack([r.normal(size=(30, 3)), [[1e200, 1e200, 0.0], [1e300, -1e300, 1e300], [-1e308, 1e308, 0.0]]])
    q = np.array([[1.0, 0, 0], [1e200, 1e-200, 0], [1e308, 1e308, 1e308]])
    got = nearest.tile_top(np.array([100, 101, 102]), q, np.arange(33), c, 5)

    def score(a, b):
        exact = sum(Fraction(float(x)) * Fraction(float(y)) for x, y in zip(a, b, strict=True))
        try:
            return float(exact)
        except OverflowError:  # beyond the largest double: infinite, and equal to all others there
            return np.inf if exact > 0 else -np.inf

    for row, found in zip(q, got, strict=True):
        best = sorted(range(33), key=lambda i: (-score(c[i], row), i))[:5]
        assert len(found) == 5 and {i for _, i in found} == set(best)
        assert not any(np.isnan(s) for s, _ in found)
    assert got[0][0] == (-1e300, 31) and got[0][1] == (-1e200, 30)


def test_blocks_are_bounded_in_bytes(spark):
    assert tiles.block_rows(10**9, 64, 1 << 13, 8 * 768, tiles.ROW_BYTES) * 8 * 768 <= tiles.ROW_BYTES
    assert tiles.block_rows(100, 64, 1 << 13, 512, tiles.ROW_BYTES) == 1 << 13
    r = np.random.default_rng(5)
    v = r.normal(size=(60, 768)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    whole = v.astype(float)
    for x in nearest.nearest(df, k=3).filter("rank = 1").collect():
        scores = whole @ whole[x.query_id]
        scores[x.query_id] = -np.inf
        assert x.vec_id == scores.argmax()
    for x in hamming.hamming_top(df, k=3).filter("rank = 1").collect():
        far = ((v > 0) != (v[x.query_id] > 0)).sum(axis=1)
        far[x.query_id] = 10_000
        assert (x.vec_id, x.distance) == (far.argmin(), far.min())
