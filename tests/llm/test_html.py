"""Main text of pages: marks, differencing of unmarked pages, and brute force over the given pages."""

import html as entities
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from tablematch.llm import html, queries


@pytest.mark.parametrize("page,want", [
    ("", ""), ("no markup at all\n  two", "no markup at all two"), ("a < b &lt;i&gt; &amp;amp; &eacute;", "a < b <i> &amp; é"),
    ("<article><h1>T</h1><p>a<p>b <b>bold</b>\n c<br>d</article><footer>f</footer>", "T\na\nb bold c\nd"),
    ("<html><head><title>t</title><body><nav>n</nav><main><header><h1>H</h1></header>x<aside>y</aside>z</main>q", "H\nx\nz"),
    ("<head><title>t</title><p>head ends here</p>", "head ends here"),
    ("<article>a<div class='x comments-list'>c<article>d</article></div><script>if (a</b) '</p>'</script>e</article><article class=comment>f</article>", "a\ne"),
    ("<div id=cookie-notice>c</div><div class=page><p>text</div><div role=navigation>m</div><form>q</form><p hidden>h", "text"),
    ("<form><article>in a form<form>f</form></article></form>", "in a form"), ("<aside><article>teaser</article></aside><article>own</article>", "own"),
    ("<article>a<!-- x > <p>y --><style>p{}</style> b<!-- open > z", "a b"), ("<article><table><tr><td>1<td>2<tr><td>3</table>x", "1 2\n3\nx"),
    ("<article><img alt='a > b'>c<p title=\"x>y\">d</article>", "c\nd"), ("<article>kept<p>cut <a hr", "kept\ncut"),
    ("<article><span class=ad>a<span>b</span>c</span>d <i>e<b>f</i>g</b></article>", "d ef" + "g"), ("<nav>only</nav>", ""),
    ("<article><ul><li>a<li>b<ul><li>c</ul><li>d</ul><header class=article-header>h</header></article>", "a\nb\nc\nd\nh"),
    ("<article>a&nbsp;\t b</article>", "a b"), ("<b>" * 5000 + "deep" + "</i></b>" * 5000 + "<p>" * 5000, "deep"), ("<" * 9000 + ">" * 9000, None),
])
def test_marks(page, want):
    got = html.main_text(page)
    assert want is None or got == want


def lcs(a, b):
    rows = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1, j + 1] = rows[i, j] + 1 if x == y else max(rows[i, j + 1], rows[i + 1, j])
    return rows[-1, -1]


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(rng.choice((2, 6, 30))) for _ in range(rng.randrange(40))] for _ in "ab")
        found = html.common_lines(np.array(a, np.int64), np.array(b, np.int64))
        places = iter(b)
        assert len(found) == lcs(a, b) and found == sorted(set(found)) and all(a[i] in places for i in found)


def test_long_pages_align():
    a = np.arange(40_000) % 7
    assert len(html.common_lines(a, np.r_[a[5:], a[:3]])) >= 39_995


def body(*lines):
    return "<html><body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body></html>"


PAGES = [
    (1, "http://h/a/1?x=1", body("menu one", "first text", "menu two")), (2, "http://h/a/2", body("menu one", "second text", "more", "menu two")),
    (3, "http://H/b/9", body("other frame", "third text", "menu two")), (4, "http://k/a/1", body("menu one", "alone on its host")),
    (5, "http://m/1", body("frame", "a long line that two copies share and that stays")), (6, "http://m/2", body("frame", "a long line that two copies share and that stays")),
    (7, "http://n/1", "<article>shared</article><p>f"), (8, "http://n/2", "<article>shared</article><p>f"), (9, None, body("no url")), (10, "http://h/a/1", None),
    (None, "http://h/a/2", body("menu one", "second text", "more", "menu two")), (2, "http://h/a/2", body("menu one", "second text", "more", "menu two")),
]
WANT = {
    1: "first text", 2: "second text\nmore", 3: "other frame\nthird text", 4: "menu one\nalone on its host", 5: PAGES[4][2], 6: PAGES[4][2], 7: "shared",
    8: "shared", 9: "no url", 10: "", None: "second text\nmore",
}


def test_differencing(spark):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS id", "2 AS page", "3 AS shared", "4 AS host")
    got = html.extract_text(frame.repartition(3)).collect()
    assert len(got) == len(PAGES)
    for r in got:
        want = WANT[r.page_id]
        assert r.text == ("frame\na long line that two copies share and that stays" if r.page_id in (5, 6) else want)
    assert {r.url for r in got} == {p[1] for p in PAGES}
    assert html.extract_text(frame.limit(0)).count() == 0


def test_differencing_equals_plain_python(spark):
    rng = random.Random(7)
    rows, seen = [], {}
    for i in range(300):
        lines = [f"frame {k} of {i % 3}" for k in range(rng.randrange(6))] + [f"text {i} {k} " + "x" * 40 for k in range(rng.randrange(1, 5))] + [f"end {i % 3}"]
        rows.append((i, f"http://host{i % 3}/{rng.randrange(9)}/{i}", body(*lines)))
    for _, url, page in rows:
        seen.setdefault(url.split("/")[2], []).append((url.split("/", 3)[3], html.lines_of(page)[0]))
    want = {}
    for i, url, page in rows:
        own, order = html.lines_of(page)[0], sorted(seen[url.split("/")[2]])
        at = order.index((url.split("/", 3)[3], own))
        near = sorted([order[k] for k in (at - 1, at + 1) if 0 <= k < len(order)], key=lambda x: -(x[0].split("/")[0] == url.split("/")[3]))
        gone = []
        for _, theirs in near:
            frame = [x for x in own if x in theirs]
            if sum(map(len, frame)) < 0.8 * max(sum(map(len, own)), sum(map(len, theirs))):
                gone = frame
                break
        want[i] = "\n".join(x for x in own if x not in gone)
    got = html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5))
    assert {r.page_id: r.text for r in got.collect()} == want


def test_query_on_the_given_pages(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.page_id: r for r in queries.QUERIES["op11_html"](spark, folder).collect()}
    pages = pq.read_table(f"{folder}/pages.parquet").to_pylist()
    assert len(got) == len(pages)
    for p in pages:
        blocks = re.split(r"</?(?:p|h1|br)>", re.search(r"(?s)<article>(.*)</article>", p["html"])[1])
        lines = [" ".join(entities.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks]
        text = "\n".join(x for x in lines if x)
        assert (got[p["page_id"]].text, got[p["page_id"]].n_chars, got[p["page_id"]].url) == (text, len(text), p["url"])
