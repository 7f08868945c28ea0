"""Quality rules against plain Python."""

import math
import random
import re
from collections import Counter

from tablematch.llm import rules
from tablematch.llm.queries import QUERIES


def plain_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            dup += line in seen
        seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def histograms(text, lang):
    import unicodedata as u

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    lists = {k: v.split() for k, v in rules.COMMON_WORDS.items()}
    words = lists.get(lang or "", sorted({x for v in lists.values() for x in v}))
    lower = Counter(re.findall(r"[^\x20\x09-\x0d]+", text.lower()))
    chars = [
        sum(u.category(c) == "Ll" for c in text), sum(u.category(c) == "Lu" for c in text), sum(c in "0123456789" for c in text),
        sum(c in "#*$%&|<>" for c in text), sum(c in ".,;:!?'\"()-" for c in text), len(text) - sum(map(len, w)),
    ]
    return chars + [len(text) - sum(chars)], [lower[x] for x in words] + [len(w) - sum(lower[x] for x in words)]


def js(p, q):
    sp, sq = sum(p), sum(q)
    if not sp or not sq:
        return None
    p, q = [x / sp for x in p], [x / sq for x in q]
    d = sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q)) / 2
    return math.sqrt(max(0, d))


def plain(rows):
    """rows: (id, text, lang)."""
    refs = {}
    for _, t, lang in rows:
        c, k = histograms(t, lang)
        rc, rk = refs.setdefault(lang or "", ([0] * len(c), [0] * len(k)))
        refs[lang or ""] = ([a + b for a, b in zip(rc, c)], [a + b for a, b in zip(rk, k)])
    out = []
    for i, t, lang in rows:
        m = plain_measures(t)
        c, k = histograms(t, lang)
        dc, dw = js(c, refs[lang or ""][0]), js(k, refs[lang or ""][1])
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        out.append((i, *m, failed, not failed and dc <= rules.MAX_CHARS and (m[0] < rules.MIN_WORDS_FOR_COMMON or dw <= rules.MAX_WORDS)))
    return out


def test_equals_plain(spark):
    rng = random.Random(11)
    vocabulary = ["the", "of", "Der", "x#", "|", "É", "ab", "cd", "12"] + ["w%d" % i for i in range(30)]
    rows = [(i, "".join(w + rng.choice([" ", "\n", "  "]) for w in rng.choices(vocabulary, k=rng.randint(0, 120))), rng.choice(["en", "de", "xx", None])) for i in range(80)]
    rows += [(100, None, "en"), (101, "", None), (102, "a b\na b\n \n \na b", "de"), (103, "re " * 3000, "fr"), (None, "a b c", "en"), (3, rows[3][1], rows[3][2])]
    rows += [(104, " ".join("q%d" % (i % 70) for i in range(5000)), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS kept", "2 AS chars")
    got = rules.quality_rules(docs).drop("char_distance", "word_distance").collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(rows), key=str)
    assert rules.quality_rules(docs.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    assert sorted(map(tuple, QUERIES["op9_rules"](spark, sf).collect())) == sorted(plain(rows))
