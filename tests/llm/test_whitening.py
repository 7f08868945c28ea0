"""Whitening against plain numpy with exact integers."""

import math
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from tablematch.llm import queries, whitening


def whole(v):
    return v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)


def expected(vectors, most=16):
    """n, deviations, eigenvalues, components and trace, from sums of fractions."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    far = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    centred = [[n * c - s for c, s in zip(v, sums)] for v in fit]
    cov = np.array([[float(Fraction(sum(v[i] * v[j] for v in centred), n ** 3)) for j in range(len(sums))] for i in range(len(sums))])
    values, parts = np.linalg.eigh(cov)
    return n, far, values[::-1][:most], parts[:, ::-1][:, :most], np.trace(cov), np.array([[Fraction(n * c - s, n) for c, s in zip(v, sums)] for v in x], float)


def same(rows, ids, vectors, most=16):
    n, far, values, parts, trace, centred = expected(vectors, most)
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    k = int((values > 1e-12 * trace).sum())
    assert len(rows) == k * len(ids)
    for c in range(1, k + 1):
        z = centred @ parts[:, c - 1] / math.sqrt(values[c - 1])
        mine = np.array([got[i][c].whitened for i in ids])
        assert min(np.abs(mine - z).max(), np.abs(mine + z).max()) < 1e-6
        assert all(got[i][c].n == n and got[i][c].deviation == d for i, d in zip(ids, far))
        assert all(abs(got[i][c].explained - values[c - 1] / trace) <= 1e-4 * values[c - 1] / trace and got[i][c].identity_error <= 1e-4 for i in ids)


def test_query_equals_numpy(spark):
    folder = "/root/testdata/sf0.001"
    table = pq.read_table(f"{folder}/embeddings.parquet").to_pylist()
    kept = [r for r in table if whole(r["embedding"])]
    same(queries.QUERIES["op13_whitening"](spark, folder).collect(), [r["vec_id"] for r in kept], [r["embedding"] for r in kept])


def test_scatter_is_exact():
    rng = np.random.default_rng(3)
    for top in (1, 2, 300, 1 << 40):
        x = rng.integers(0, top, (200, 5))
        counts = {}
        whitening.scatter(x, counts)
        whitening.scatter(x[:7], counts)
        sums = {}
        for (i, j, w), ones in counts.items():
            sums[i, j] = sums.get((i, j), 0) + (ones << w)
        both = np.vstack([x, x[:7]]).astype(object)
        assert all(sums.get((i, j), 0) == int((both[:, i] * both[:, j]).sum()) for i in range(5) for j in range(i, 5))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.5, -0.25, 3.0], [0.1, 0.2, 0.3], [0.1001, 0.2001, 0.3001], [-4.0, 1e3, 0.0], [0.0, 0.0, 0.0], [7.0, 8.5, -1e4]]
    rows = [(i, v) for i, v in enumerate(good)] + [(7, good[0]), (7, good[0]), (None, good[1])]
    bad = [(20, None), (21, []), (22, [1.0, None, 2.0]), (23, [nan, 1.0, 2.0]), (24, [inf, 0.0, 0.0]), (25, [1.0, 2.0]), (26, [1e300, 0.0, 0.0])]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 AS x", "2 AS n", "3 AS _id").repartition(3)
    got = whitening.whiten(frame).collect()
    assert sum(r.vec_id is None for r in got) == 3 and sum(r.vec_id == 7 for r in got) == 6 and {r.n for r in got} == {5}
    same([r for r in got if r.vec_id is not None and r.vec_id != 7], range(6), good)
    assert {r.whitened for r in got if r.vec_id == 7} == {r.whitened for r in got if r.vec_id == 0}


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_nothing_varies(spark, rows):
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_components_of_a_plane(spark):
    rows = [(i, [i % 7.0, i % 5.0, i % 7.0 + i % 5.0]) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=16).collect()
    assert {r.component for r in got} == {1, 2}
    same(got, range(40), [v for _, v in rows])
