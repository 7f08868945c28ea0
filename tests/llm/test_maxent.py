"""Language-model scores: the base against plain Python, held-out gain, odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablematch.llm import maxent
from tablematch.llm.queries import QUERIES


def plain(rows, held):
    """rows: (id, text); held: bool per row."""
    texts = []
    for _, t in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        texts.append(re.findall(r"[^\x20\x09-\x0d]+", t) + [None])
    counts = Counter(w for t, h in zip(texts, held) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    return [(r[0], h, len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)) for r, h, t in zip(rows, held, texts)]


def same(got, want):
    got = sorted(([*r[:5], round(r[5], 6)] for r in got), key=str)
    assert got == sorted(([*w[:5], round(w[5], 6)] for w in want), key=str)


@pytest.mark.parametrize("frequent", [65_536, 40])
def test_base_and_odd_rows(spark, monkeypatch, frequent):
    monkeypatch.setattr(maxent, "FREQUENT", frequent)
    rng = np.random.default_rng(5)
    vocabulary = ["The", "É", "of,"] + ["w%d" % i for i in range(200)]
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 80))))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \n x"), (None, "the of"), (3, rows[3][1]), (503, "unseen words only")]
    held = [r[0] is not None and r[0] % 5 == 0 or r[0] == 503 for r in rows]
    docs = spark.createDataFrame([(*r, h) for r, h in zip(rows, held)], "doc_id long, text string, score boolean")
    out = maxent.score_texts(docs, F.col("score"), every=1, rounds=1).collect()
    same(out, plain(rows, held))
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    assert maxent.score_texts(docs.limit(0), F.col("score"), every=1, rounds=1).count() == 0
    none = maxent.score_texts(docs, F.lit(True), every=1, rounds=1).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and abs(r.base_score) < 1e-9 and r.score <= 0 for r in none)


def test_query_beats_the_base_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    held = [zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    out = QUERIES["op4_maxent"](spark, sf).collect()
    same(out, plain(rows, held))
    mine, base, n = (sum(getattr(r, c) for r in out if r.held_out) for c in ("score", "base_score", "n_tokens"))
    print("per held-out token", mine / n, base / n)
    assert mine > base


def test_probabilities_add_up():
    """Over all known words and one unknown per class of endings, the chances of the next token add up to 1."""
    rng = np.random.default_rng(6)
    bias, weights = rng.standard_normal(64).astype(np.float32), rng.standard_normal((maxent.ROWS, 64)).astype(np.float32)
    p = maxent.softmax(weights, bias, rng.integers(0, maxent.ROWS, (5, 4)))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)


def test_every_token_trains(spark):
    rows = spark.createDataFrame([("a b c a",), ("",), ("c " * 500,)], "_text string").select(F.xxhash64("_text").alias("_h"), "_text")
    counts = maxent.collected(maxent.word_counts(rows))
    shown = maxent.examples(rows, counts, maxent.EVERY, maxent.ROUNDS).collect()
    assert sum(len(r.classes) for r in shown) == 5 + 1 + 501 == counts.n
    assert all(len(r.rows) == 2 * 4 * len(r.classes) for r in shown) and {r["round"] for r in shown} == set(range(maxent.ROUNDS))


def test_row_sums():
    rng = np.random.default_rng(8)
    for top in (1, 3, 20, 4000):
        rows, gradient = rng.integers(0, top, (300, 4)), rng.standard_normal((300, 8))
        want = np.zeros((top, 8))
        np.add.at(want, rows.ravel(), np.repeat(gradient, 4, axis=0))
        touched, sums = maxent.row_sums(gradient, rows)
        assert sorted(touched) == sorted(set(rows.ravel())) and np.allclose(sums, want[touched])
