"""Repeated line runs against plain Python."""

import random

import pytest

from checks.compare import check
from tablematch.llm import lines, queries


def plain(rows, m):
    texts = sorted({(r[0], r[1] or "") for r in rows}, key=lambda x: (x[0] is None, x[0] or 0))
    seen, out = set(), {}
    for key in texts:
        ls = key[1].split("\n")
        gone = set()
        for i in range(len(ls) - m + 1):
            w = tuple(ls[i:i + m])
            if w in seen:
                gone.update(range(i, i + m))
            seen.add(w)
        runs = [i for i in gone if i - 1 not in gone]
        longest = max((next(k for k in range(1, len(ls) + 1) if i + k not in gone) for i in runs), default=0)
        out[key] = (len(ls), len(gone), len(runs), longest, "\n".join(x for i, x in enumerate(ls) if i not in gone))
    return [(r[0], *out[r[0], r[1] or ""]) for r in rows]


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_equals_plain(spark, m):
    rng = random.Random(m)
    pool = ["", "a", "b", "c", "d é", " "]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 12))), "x") for i in rng.sample(range(-50, 200), 60)]
    rows += [(900, None, "x"), (901, "", "x"), (None, "a\nb\nc", "x"), (902, "a\n" * 50, None), (rows[0][0], rows[0][1], "x"), (2**62, "a\nb", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line string")
    got = lines.remove_repeated_lines(docs, min_lines=m).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(rows, m), key=str)


def test_empty_table(spark):
    assert lines.remove_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_sql(spark):
    good, why = check(spark, "/root/testdata/sf0.001", "op1_lines", queries.QUERIES["op1_lines"], queries.ORACLES["op1_lines"])
    assert good, why
