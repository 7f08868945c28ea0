"""Manifests against a plain tree, and against SQL."""

import hashlib
import random
import zlib

import pytest

from checks.compare import check
from pyspark.sql import functions as F
from tablematch.llm import manifest, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes, fanout):
    """Root, and per leaf the list of (left, right) to the root."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // fanout * fanout:][:fanout]
            ways[i].append(("".join(run[:p % fanout]), "".join(run[p % fanout + 1:])))
        nodes = [h(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [p // fanout for p in at]
    return nodes[0], ways


def expected(rows, now, fanout):
    """Sorted results of rows (doc_id, text, lang, source, n_chars); `now` gives the text found."""
    groups = {}
    for r in rows:
        i, text, lang, source, n = r
        found = (i, source, lang, n, now(r))
        groups.setdefault(source, []).append(((i is not None, i or 0), leaf((i, source, lang, n, text)), leaf(found), i))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: x[:2])
    lower = {s: tree([x[1] for x in groups[s]], fanout) for s in order}
    root, upper = tree([lower[s][0] for s in order], fanout)
    out = []
    for s, up in zip(order, upper):
        for (_, own, found, i), way in zip(groups[s], lower[s][1]):
            fold = found
            for left, right in way + up:
                fold = h(left, fold, right)
            out.append((i, own, lower[s][0], root, h(*[x for step in way + up for x in step]), fold, fold == root))
    return sorted(out, key=str)


def now(row):
    i, text = row[0], row[1]
    return text.replace("\n", "") if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def run(spark, rows, fanout):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS place", "2 AS digest", "'x' AS tree", "3 AS leaf").repartition(3)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest.merkle_manifest(frame, found={"text": text}, fanout=fanout)


@pytest.mark.parametrize("fanout", [2, 3])
def test_equals_a_plain_tree(spark, fanout):
    rng = random.Random(fanout)
    rows = [(-7, "a\nb", "en", "", 3), (None, "x\ny", "en", "s1", 3), (None, None, None, None, None), (5, "", "é", "1", 0), (5, "", "é", "1", 0), (5, "other", "é", "1", 0)]
    for source, n in (("s1", 1), ("é", 2), ("z", 3), ("Z", 4), ("big", 29), (None, 9)):
        rows += [(rng.randrange(10**9), rng.choice(["é\nü", "line\nline\n", "flat", "\n" * 50, "long " * 5000]), "fr", source, i) for i in range(n)]
    got = run(spark, rows, fanout).collect()
    assert sorted([tuple(r) for r in got], key=str) == expected(rows, now, fanout)
    assert any(r.verified for r in got) and not all(r.verified for r in got)


def test_one_row_and_no_rows(spark):
    row = (1, "a", "en", "s", 1)
    assert [tuple(r) for r in run(spark, [row], 3).collect()] == expected([row], now, 3)
    assert run(spark, [], 3).count() == 0


def test_unchanged_rows_verify(spark):
    frame = spark.createDataFrame([(i, "a\n", "en", "s", 1) for i in range(12)], SCHEMA)
    assert all(r.verified for r in manifest.merkle_manifest(frame).collect())


def test_query_equals_sql(spark):
    good, why = check(spark, "/root/testdata/sf0.001", "op12_manifest", queries.QUERIES["op12_manifest"], queries.ORACLES["op12_manifest"])
    assert good, why
