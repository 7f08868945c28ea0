"""Sketches of columns, their merging, and overlaps of all column pairs against brute force."""

import random
from itertools import permutations

import pytest

from tablematch.operators import catalogue as cg


def tables(spark, rng):
    out = {}
    for t in "abcd":
        rows = []
        for i in range(700):
            x = rng.choice([None, " 7 ", "7", ""]) if rng.random() < 0.3 else str(rng.randrange(900) + 100 * ord(t))
            rows.append((x, i if t < "c" else 10_000 + i, rng.choice(["yes", "no"]), t))
        out[t] = spark.createDataFrame(rows, "x string, n long, flag string, own string").repartition(3)
    return out


def brute(given, least):
    sets = {(t, c): {str(r[c]).strip(" ") for r in df.collect() if r[c] is not None} for t, df in given.items() for c in df.columns}
    out = {}
    for (t, c), a in sets.items():
        for (u, d), b in sets.items():
            if t < u and a & b and len(a & b) / len(a | b) >= least:
                out[t, c, u, d] = (len(a & b), round(len(a & b) / len(a | b), 9))
    return out


@pytest.mark.parametrize("least", [0.1, 0.0001])
def test_overlaps_equal_brute_force(spark, least):
    given = tables(spark, random.Random(5))
    k = 256 if least == 0.1 else 5000
    got = {(r.table_a, r.column_a, r.table_b, r.column_b): (r.shared, round(r.overlap, 9)) for r in cg.catalogue_overlaps(given, least, k).collect()}
    assert got == brute(given, least) and len(got) > 3


def test_sketches_of_parts_merge_into_the_whole(spark, tmp_path):
    numbers = spark.range(20_000).selectExpr("CAST(id % 7001 AS string) AS v", "CAST(NULL AS string) AS nothing", "'same' AS same")
    whole = {r.column_name: r for r in cg.sketch_columns("t", numbers, 64).collect()}
    for version, part in enumerate(("v < '3'", "v >= '3'")):
        cg.store_sketches(cg.sketch_columns("t", numbers.where(part), 64), str(tmp_path / "s"), version)
    cg.store_sketches(cg.sketch_columns("t", numbers.where("v < '3'"), 64), str(tmp_path / "s"), 0)
    stored = cg.stored_sketches(spark, str(tmp_path / "s"))
    assert stored.count() == 6
    merged = {r.column_name: r for r in cg.merge_sketches(stored, 64).collect()}
    assert {c: (r.filled, r.complete, r.hashes) for c, r in merged.items()} == {c: (r.filled, r.complete, r.hashes) for c, r in whole.items()}
    assert len(whole["v"].hashes) == 64 and not whole["v"].complete
    assert whole["nothing"].hashes == [] and whole["nothing"].complete and len(whole["same"].hashes) == 1


def test_estimates(spark):
    a = spark.range(10_000).selectExpr("id AS x")
    b = spark.range(5000, 15_000).selectExpr("id AS y", "id + 1000000 AS z")
    sketches = cg.sketch_columns("a", a).union(cg.sketch_columns("b", b))
    found = {r.column_b: r.estimate for r in cg.overlap_candidates(sketches).collect()}
    assert set(found) == {"y"} and abs(found["y"] - 1 / 3) < 0.12


def test_nothing_shared_and_empty_tables(spark):
    empty = spark.createDataFrame([], "x string, y long")
    assert cg.catalogue_overlaps({"a": empty, "b": empty}).count() == 0
    assert cg.catalogue_overlaps({"a": spark.range(3), "b": empty}).count() == 0
    with pytest.raises(ValueError):
        cg.catalogue_overlaps({})


def test_assignment_is_the_best_one(spark):
    rng = random.Random(9)
    rows, best = [], {}
    for t in "uvw":
        n, m = rng.randrange(2, 5), rng.randrange(2, 5)
        scores = [[rng.choice([0, rng.randrange(1000, 9999)]) for _ in range(m)] for _ in range(n)]
        rows += [(t, i, f"c{i}", "z", j, f"d{j}", s, s / 10_000) for i, line in enumerate(scores) for j, s in enumerate(line) if s]
        wide = [line + [0] * n for line in scores]
        best[t] = max(sum(wide[i][p] for i, p in enumerate(way)) for way in permutations(range(m + n), n))
    frame = spark.createDataFrame(rows, "table_a string, pos_a int, column_a string, table_b string, pos_b int, column_b string, shared long, overlap double")
    got = cg.assign_by_overlap(frame).collect()
    assert {t: sum(r.score for r in got if r.table_a == t) for t in best} == best
    assert len({(r.table_a, r.column_a) for r in got}) == len(got) == len({(r.table_a, r.column_b) for r in got})
