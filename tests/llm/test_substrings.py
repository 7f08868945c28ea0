"""Repeated passages against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from tablematch.llm import substrings
from tablematch.llm.queries import QUERIES


def plain(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("window,prefix,group", [(6, 2, 20_000), (6, 2, 1), (5, 5, 20_000)])
def test_equals_brute_force(spark, window, prefix, group):
    rng = random.Random(window + group)
    vocabulary = ["a", "b", "É", "d,"] + ["w%d" % i for i in range(40)]
    passages = [rng.choices(vocabulary, k=rng.randint(3, 25)) for _ in range(6)]
    rows = []
    for i in range(60):
        t = []
        for _ in range(rng.randint(0, 4)):
            t += rng.choices(vocabulary, k=rng.randint(0, 12)) + (rng.choice(passages) if rng.random() < 0.5 else [])
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(t), "x"))
    rows += [(100, "re " * 40, None), (101, "one two " * 5, None), (102, None, "y"), (103, "", "y"), (None, rows[5][1], "z"), (7, rows[7][1], "x"), (104, "  a b", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_text string")
    got = substrings.remove_repeats(docs, window=window, prefix=prefix, group=group).collect()
    want = [(r[0], *p) for r, p in zip(rows, plain([r[1] for r in rows], window))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r[0]: (n, k, hashlib.sha256(t.encode()).hexdigest()) for r, (n, k, t) in zip(rows, plain([r[1] for r in rows], 35))}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op7_substrings"](spark, sf).collect()} == want
    assert any(k for _, k, _ in want.values())
