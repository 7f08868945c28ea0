"""Skew-safe ranking, similarity and assignments against brute force."""

import collections
import hashlib
import itertools
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablematch.config import DEFAULTS
from tablematch.plans.assign import best_first, match_texts, optimal_pairs
from tablematch.plans.similarity import text_similarities
from tablematch.plans.skew import find_hot, first_rows, ranked

SMALL = replace(DEFAULTS, hot_group_rows=3)


def test_ranked_slices_hot_groups(spark):
    random.seed(5)
    rows = [("hot" if random.random() < 0.5 else f"k{random.randrange(8)}", r) for r in random.sample(range(10_000), 80)]
    df = spark.createDataFrame(rows, "k string, _rid long")
    hot = find_hot(df, ["k"], SMALL)
    assert hot is not None
    got = {(r.k, r["_rid"]): r.pos for r in ranked(df, ["k"], "_rid", "pos", hot, settings=SMALL).collect()}
    want = {}
    for k in {k for k, _ in rows}:
        for i, r in enumerate(sorted(r for kk, r in rows if kk == k)):
            want[(k, r)] = i + 1
    assert got == want


def test_hot_groups_by_their_own_size(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("k"), F.col("id").alias("_rid"))
    assert find_hot(df, ["k"], replace(SMALL, hot_group_rows=100)) is None
    assert find_hot(df, ["k"], replace(SMALL, hot_group_rows=99)).count() == 10


def test_first_rows_limit_before_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("_rid"))
    plan = first_rows(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert sorted(r["_rid"] for r in first_rows(df, ["k"]).collect()) == [0, 1, 2]


def grams(text):
    out = collections.Counter()
    for w in text.lower().split():
        w = f" {w} "
        for n in (2, 3, 4):
            for i in range(len(w) - n + 1):
                out[w[i:i + n]] += 1
    return out


def brute_scores(left, right):
    texts = [t for _, t in left + right if t.strip()]
    df = collections.Counter(g for t in texts for g in grams(t))

    def vector(t):
        v = {g: n * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, n in grams(t).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / norm for g, x in v.items()}

    lv = [(i, vector(t)) for i, t in left if t.strip()]
    rv = [(i, vector(t)) for i, t in right if t.strip()]
    return {(a, b): sum(x * w.get(g, 0.0) for g, x in v.items()) for (a, v), (b, w) in itertools.product(lv, rv)}


WORDS = ["alpha", "beta", "gamma", "project", "trade", "north", "south", "service", "group", "x1", "x2", "77"]


def random_texts(n, seed, start=0):
    rnd = random.Random(seed)
    return [(start + i, " ".join(rnd.choices(WORDS, k=rnd.randint(0, 4)))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_similarity_is_exact(spark, seed):
    left, right = random_texts(40, seed), random_texts(40, seed + 100)
    want = {k: s for k, s in brute_scores(left, right).items() if s >= 0.6}
    l = spark.createDataFrame(left, "rid long, text string")
    r = spark.createDataFrame(right, "rid long, text string")
    got = {(x.l_id, x.r_id): x.score for x in text_similarities(l, r).collect()}
    first_l, first_r = {}, {}
    for i, t in left:
        first_l.setdefault(t, i)
    for i, t in right:
        first_r.setdefault(t, i)
    tl, tr = dict(left), dict(right)
    assert {(first_l[tl[a]], first_r[tr[b]]) for a, b in want} == set(got)
    for (a, b), s in want.items():
        assert abs(got[(first_l[tl[a]], first_r[tr[b]])] - s) < 1e-9


def greedy(edges, caps_l, caps_r):
    """Plain best-first over nodes with capacities."""
    used_l, used_r, out = collections.Counter(), collections.Counter(), []
    def tie(l, r):
        return int(hashlib.md5(f"{l}:{r}".encode()).hexdigest()[:15], 16)

    for l, r, s in sorted(edges, key=lambda e: (-e[2], -tie(e[0], e[1]))):
        m = min(caps_l[l] - used_l[l], caps_r[r] - used_r[r])
        if m > 0:
            out.append((l, r, s, used_l[l], used_r[r], m))
            used_l[l] += m
            used_r[r] += m
    return sorted(out)


@pytest.mark.parametrize("seed", [3, 4])
def test_best_first_under_contention(spark, seed):
    rnd = random.Random(seed)
    caps_l = {i: rnd.choice([1, 1, 2, 5]) for i in range(12)}
    caps_r = {i: rnd.choice([1, 1, 3]) for i in range(12)}
    edges = [(l, r, rnd.choice([0.6, 0.7, 0.8, 0.9])) for l in caps_l for r in caps_r if rnd.random() < 0.5]
    df = spark.createDataFrame([(l, r, s, caps_l[l], caps_r[r]) for l, r, s in edges], "l_id long, r_id long, score double, l_n long, r_n long")
    got = sorted((x.l_id, x.r_id, x.score, x.l_from, x.r_from, x.m) for x in best_first(df).collect())
    assert got == greedy(edges, caps_l, caps_r)


def test_equal_scores_take_few_rounds(spark, monkeypatch):
    from tablematch.plans import assign

    written = []
    monkeypatch.setattr(assign, "durable", lambda df, kept=assign.durable: written.append(1) or kept(df))
    left = spark.range(60).select(F.col("id").alias("l_id"), F.lit(1).alias("l_n"), F.lit(0.9).alias("score"))
    edges = left.crossJoin(spark.range(60).select(F.col("id").alias("r_id"), F.lit(1).alias("r_n")))
    assert best_first(edges).count() == 60
    assert len(written) <= 1 + 2 * 12


def test_best_first_without_edges(spark):
    assert best_first(spark.createDataFrame([], "l_id long, r_id long, score double, l_n long, r_n long")).count() == 0


def test_repeated_texts_are_paired_in_row_order(spark):
    left = [(i, "Alpha Project") for i in (4, 1, 9, 7, 3)] + [(20, "unlike"), (21, " ")]
    right = [(i, "Project Alpha x") for i in (8, 2, 6)] + [(30, "Alpha Projects"), (31, "")]
    l = spark.createDataFrame(left, "rid long, text string")
    r = spark.createDataFrame(right, "rid long, text string")
    got = sorted((x.left_rid, x.right_rid) for x in match_texts(l, r, SMALL).collect())
    scores = brute_scores([left[0]], right)
    assert len(got) == 4
    near = 30 if scores[(4, 30)] > scores[(4, 8)] else None
    rights = [30, 2, 6, 8] if near else [2, 6, 8, 30]
    assert got == list(zip([1, 3, 4, 7], rights))


def test_optimal_pairs_match_brute_force():
    random.seed(2)
    np.random.seed(2)
    for _ in range(200):
        rows, cols = random.randint(1, 5), random.randint(1, 5)
        m = np.round(np.random.rand(rows, cols), random.choice([1, 4]))
        pairs = optimal_pairs(m)
        assert len({r for r, _ in pairs}) == len({c for _, c in pairs}) == min(rows, cols)
        wide = m if rows <= cols else m.T
        best = max(sum(wide[i, p[i]] for i in range(len(wide))) for p in itertools.permutations(range(wide.shape[1]), len(wide)))
        assert abs(sum(m[r, c] for r, c in pairs) - best) < 1e-9


def test_no_local_work_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from tablematch.plans.skew import work_folder

    settings = {"spark.sql.warehouse.dir": "file:/tmp/warehouse"}
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: settings.get(k, d)), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_folder(cluster)
