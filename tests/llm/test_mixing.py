"""Mixtures: shares, repeatability, SQL."""

import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from checks.compare import check
from tablematch.llm import mixing, queries


def plain_count(rate, i, seed):
    u = int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u and k < 1000:
        k += 1
        p *= rate / k
        total += p
    return k


def test_counts_and_columns(spark):
    rows = [(i, "ab" * (i % 5 + 1), ["x", "y", None][i % 3 if i % 9 else 0], i) for i in range(300)]
    rows += [(None, "text", "x", 0), (7, rows[7][1], rows[7][2], 7), (500, None, "x", 1), (501, None, "blank", 1), (502, "", "blank", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")
    weights = {"x": 1.0, "y": 5.0, None: 2.0, "gone": 3.0}
    chars = Counter()
    for r in rows:
        chars[r[2]] += len(r[1] or "")
    total, held = sum(chars.values()), {k: w for k, w in weights.items() if chars[k]}
    want = Counter()
    for r in rows:
        if r[2] in held:
            rate = 2.0 * held[r[2]] / sum(held.values()) * total / chars[r[2]]
            for k in range(plain_count(rate, r[0], mixing.SEED)):
                want[r[0], r[1], r[2], k + 1] += 1
    out = mixing.mix(docs, weights, size=2.0)
    assert out.columns == ["doc_id", "text", "source", "copy"]
    assert Counter(map(tuple, out.collect())) == want
    assert mixing.mix(docs.limit(0), weights).count() == 0


def test_shares_come_near_the_target(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.when(F.col("id") % 10 < 8, "large").otherwise("small").alias("source")
    )
    got = {r.source: r.n for r in mixing.mix(docs).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(got["large"] / 10_000 - 1) < 0.05 and abs(got["small"] / 10_000 - 1) < 0.05


def test_large_rates(spark):
    docs = spark.createDataFrame([(1, "a", "s"), (2, "b" * 3999, "l")], "doc_id long, text string, source string")
    n = {r.source: r.n for r in mixing.mix(docs).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert 1800 < n["s"] < 2200


def test_query_equals_sql(spark):
    good, why = check(spark, "/root/testdata/sf0.001", "op2_mixing", queries.QUERIES["op2_mixing"], queries.ORACLES["op2_mixing"])
    assert good, why
