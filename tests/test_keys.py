"""Keys of several columns against all sets of columns."""

import random
from itertools import combinations

import pytest

from tablematch.operators.keys import KeySearch, composite_keys, suggested_keys


def brute(rows, names, most):
    full = [i for i in range(len(names)) if all(r[i] is not None and str(r[i]).strip() for r in rows)]
    out = []
    for k in range(1, most + 1):
        for s in combinations(full, k):
            if rows and len({tuple(r[i] for i in s) for r in rows}) == len(rows) and not any(set(o) <= set(s) for o in out):
                out.append(s)
    return [tuple(names[i] for i in s) for s in out]


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    sizes = [(40, 40, 3, 2, 50), (300, 4, 5, 60, 2), (9, 9, 9, 9, 9), (200, 200, 200, 200, 2)][seed]
    rows = [tuple(rng.randrange(k) for k in sizes) for _ in range(250)]
    names = ["a", "b c", "_n", "d", "e`f".replace("`", "")]
    df = spark.createDataFrame(rows, ", ".join(f"`{x}` int" for x in names))
    assert [tuple(r.key_columns) for r in composite_keys(df, max_size=4).collect()] == brute(rows, names, 4)


def test_rows_grow_fewer(spark):
    df = spark.range(4000).selectExpr("id DIV 2 AS pair", "id % 2 AS side", "id % 5 AS other", "'x' AS same")
    search = KeySearch(df, max_size=3)
    assert search.keys == [("pair", "side"), ("pair", "other")]
    assert search.checked[("pair", "side")] == 4000 and suggested_keys(df) == ["pair", "side"]
    almost = spark.range(4000).selectExpr("CASE WHEN id = 1 THEN 0 ELSE id END AS nearly", "id % 7 AS k", "id DIV 2 AS pair")
    search = KeySearch(almost)
    assert search.checked == {("nearly",): 4000, ("nearly", "k"): 2, ("nearly", "pair"): 2, ("k", "pair"): 4000}


def test_no_rows_one_row_and_blank_cells(spark):
    schema = "a int, b string"
    assert composite_keys(spark.createDataFrame([], schema)).count() == 0 and suggested_keys(spark.createDataFrame([], schema)) == []
    assert [r.key_columns for r in composite_keys(spark.createDataFrame([(1, "x")], schema)).collect()] == [["a"], ["b"]]
    assert [r.key_columns for r in composite_keys(spark.createDataFrame([(1, "x"), (2, " "), (3, None)], schema)).collect()] == [["a"]]
    assert suggested_keys(spark.createDataFrame([(1, "x"), (1, "x")], schema)) == []
