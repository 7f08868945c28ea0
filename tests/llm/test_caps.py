"""Near-duplicate vectors against brute force."""

import math

import numpy as np
import pytest

from tablematch.llm import caps
from tablematch.llm.queries import QUERIES


def plain(rows, threshold):
    """rows: (id, vector)."""
    units = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            v = np.array(v, float) / max(map(abs, v))
            units[i] = v / np.linalg.norm(v)
    near = {i: {j for j in units if j != i and len(units[j]) == len(units[i]) and units[i] @ units[j] >= threshold} for i in units}
    out = []
    for i, _ in rows:
        seen, queue = {i}, [i]
        while queue:
            for j in near.get(queue.pop(), set()) - seen:
                seen.add(j), queue.append(j)
        least = None if i is None else min(seen)
        out.append((i, len(near.get(i, ())), least, i is not None and least == i))
    return out


@pytest.mark.parametrize("tile", [2048, 7])
def test_equals_brute_force(spark, tile):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(40):
        c = rng.standard_normal(24)
        for _ in range(int(rng.integers(1, 9)) if g else 40):
            rows.append((len(rows), (c + rng.standard_normal(24) * 0.02).tolist()))
    rows += [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [float("nan")] + [1.0] * 23), (1004, [None] + [1.0] * 23),
             (1005, [float("inf")] * 24), (None, rows[0][1]), (1006, [1e200] * 24), (1007, [1e-200] * 24), (1008, [1.0] * 23), rows[3], (1009, [2.0]), (1010, [3.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS kept", "2 AS unit")
    want = plain(rows, 0.95)
    got = caps.near_vectors(data, tile=tile).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert caps.near_vectors(data.limit(0)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    for size in (12, 71, 160):
        code, edge = caps.directions(64, 2, size, 5), caps.cap_edge(64, 2, size, 5, caps.CAPS)
        hit = 0
        for _ in range(400):
            x = rng.standard_normal(64)
            x /= np.linalg.norm(x)
            z = rng.standard_normal(64)
            z -= z @ x * x
            y = 0.951 * x + math.sqrt(1 - 0.951**2) * z / np.linalg.norm(z)
            hit += bool(np.intersect1d(*(caps.caps_of(v, code, edge, caps.CAPS // 2) for v in (x, y))).size)
        assert hit >= 0.97 * 400, (size, hit)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r[0], [float(x) for x in r[1]]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, QUERIES["op5_caps"](spark, sf).collect())) == sorted(plain(rows, 0.95))
