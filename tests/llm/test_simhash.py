"""SimHash groups against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablematch.llm import simhash
from tablematch.llm.queries import QUERIES


def plain_fingerprint(text, n):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance):
    """prints: (id, fingerprint)."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(prints):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return [least.get(root(i)) for i in range(len(prints))]


def test_masks_lose_no_close_pair():
    rng = random.Random(1)
    for masks in (simhash.first_masks(1000, 4), simhash.first_masks(10_000_000, 4)):
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                b ^= 1 << bit
            meet = [m & (2**64 - 1) for m in masks if not (a ^ b) & m]
            assert meet
            for m in meet[:3]:
                assert any(not (a ^ b) & f for f in simhash.finer_masks(m, 4))


def test_spanning_forest_connects_the_same():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**62, 5)
    fps = [int(b) ^ sum(1 << int(k) for k in rng.choice(61, 3)) for b in base for _ in range(40)]
    edges = simhash.spanning(np.array(fps), 4)
    assert len(edges) < len(set(fps))
    full = plain_components([(f & (2**64 - 1), f & (2**64 - 1)) for f in sorted(set(fps))], 4)
    from collections import defaultdict
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    groups = set()
    for f in set(fps):
        seen, queue = {f}, [f]
        while queue:
            for y in near[queue.pop()] - seen:
                seen.add(y), queue.append(y)
        groups.add(frozenset(seen))
    assert len(groups) == len(set(full))


@pytest.mark.parametrize("bucket", [20_000, 3])
def test_groups_equal_brute_force(spark, bucket):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(500)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 300))) for _ in range(30)]
    rows = []
    for i in range(150):
        t = rng.choice(texts).split(" ")
        if t and i % 3 == 0:
            t[rng.randrange(len(t))] = "changed"
        rows.append((i, " ".join(t), "x"))
    rows += [(900, None, "x"), (901, "", None), (902, " \n\t", "x"), (None, "lone text", "x"), (903, "A b", "x"), (903, "A b", "x"), (904, "a B", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = simhash.simhash_groups(docs, n_words=4, distance=4, bucket=bucket).collect()
    prints = [(r[0], plain_fingerprint(r[1], 4)) for r in rows]
    want = sorted(zip([p[0] for p in prints], [p[1] for p in prints], plain_components(prints, 4)), key=str)
    assert sorted([(r[0], r[1] & (2**64 - 1), r[2]) for r in got], key=str) == want
    kept = simhash.keep_one(docs, n_words=4, distance=4, bucket=bucket)
    assert kept.columns == docs.columns
    assert kept.count() == len({str(w[2]) for w in want})


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r[0], plain_fingerprint(r[1], 4)) for r in rows]
    want = {p[0]: (f"{p[1]:016x}", c) for p, c in zip(prints, plain_components(prints, 4))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op10_simhash"](spark, sf).collect()}
    assert got == want
