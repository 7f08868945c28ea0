"""Main text of web pages: marks of the page, and page differencing against the page of the nearest URL.

A page is a sequence of text lines, one per block. What its tags and attributes mark as article, menu, advert and so on is
settled by the marks. Other lines are settled by differencing: pages stand in order of host and URL path, each is aligned
with the nearest page that is no copy of it by a longest common subsequence of lines, and lines they share go.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tablematch.llm.common import slices
from tablematch.llm.order import numbered
from tablematch.plans.skew import durable, release

#: Pages that share this part of their characters or more are copies and say nothing about each other's frame.
COPY = 0.8

# Elements and words of class, id and role by their meaning in HTML and in common page templates.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody "
    "tfoot thead title tr ul".split()
)
ENDS_ITSELF = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
RAW = set("script style title noscript template textarea iframe svg math object video audio canvas".split())
HEAD = set("title base link meta script style noscript template".split())
FRAME = RAW | set("head nav header footer aside form menu dialog button select search".split())
FRAME_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
FRAME_WORDS = set(
    "ad ads adsense advert advertisement advertising adverts alert announcement banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices overlay paywall popup "
    "promo promoted promotion related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
HEADERS, COMMENTS = {"header", "masthead", "banner"}, {"comment", "comments", "disqus", "replies", "respond"}

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_CLOSED = re.compile(r"--!?>\Z|\A<!--?>\Z")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}

IN_ARTICLE, IN_MAIN, FRAMED_ARTICLE, OPEN, FRAMED = range(5)


def _is_frame(tag: str, attrs: str, inside: bool) -> bool:
    """Does this element stand for something beside the article? `inside`: it stands in the article itself."""
    if tag in FRAME and not (inside and tag == "header"):
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    words, hidden = set(), False
    for name, value in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), unescape(value).strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
            hidden = True
        elif name == "role" and value in FRAME_ROLES:
            return not (inside and value == "banner")
        elif name in ("class", "id"):
            words.update(re.split(r"[^a-z]+", value))
    if tag == "article":
        return hidden or bool(words & COMMENTS)
    return hidden or bool(words & (FRAME_WORDS - HEADERS if inside else FRAME_WORDS))


def lines_of(html: str) -> tuple[list[str], list[int]]:
    """The text lines of a page and the zone of each: in an article, in the main part, in an article within a frame, open
    (no mark says what it is), or framed (menus, adverts, hidden parts and the like; without scripts and styles)."""
    lines, zones, parts = [], [], []
    stack: list[tuple] = []  # of each open element its tag, and the four counts below as they were around it
    opened: Counter = Counter()
    article = main = 0
    frames = inner = 0  # frames around all, and those inside the article or main part

    def end_line() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                lines.append(text)
                if article:
                    zones.append(FRAMED if inner else FRAMED_ARTICLE if frames else IN_ARTICLE)
                elif main:
                    zones.append(FRAMED if inner else IN_MAIN)
                else:
                    zones.append(FRAMED if frames else OPEN)

    def leave(tag: str) -> None:
        nonlocal article, main, frames, inner
        while stack:
            name, *state = stack.pop()
            opened[name] -= 1
            if name in BLOCKS or state != [article, main, frames, inner]:
                end_line()
            article, main, frames, inner = state
            if name == tag:
                break

    place, end = 0, html.rfind(">") + 1
    while place < end:
        found = _TOKEN.search(html, place, end)
        if not found:
            break
        if found.start() > place:
            parts.append(html[place:found.start()])
        place = found.end()
        if not found[2]:
            if found.end() == end and found[0].startswith("<!--") and not _CLOSED.search(found[0]):
                place = len(html)
            continue
        tag, attrs = found[2].lower(), found[3]
        if found[1]:
            if tag == "p" and not opened["p"]:
                end_line()
            elif opened[tag]:
                leave(tag)
            if tag in ("td", "th"):
                parts.append(" ")
            continue
        if opened["head"] and tag not in HEAD:
            leave("head")
        if tag in BLOCKS:
            end_line()
            if opened["p"] and tag != "br":
                leave("p")
        if tag in VOID:
            if tag != "br" and tag != "wbr":
                parts.append(" ")
            continue
        if tag in ENDS_ITSELF and opened[tag]:
            for name, *_ in reversed(stack):
                if name == tag:
                    leave(tag)
                    break
                if name in ENDS_ITSELF[tag]:
                    break
        if tag in RAW:
            close = _END[tag].search(html, place)
            place = close.end() if close else len(html)
            continue
        held = (tag, article, main, frames, inner)
        inside = bool(article or main)
        if _is_frame(tag, attrs, inside):
            end_line()
            frames += 1
            inner += inside
        elif tag == "article":
            article, inner = article + 1, inner if article else 0
        elif tag == "main" or "main" in attrs and re.search(r"\brole\s*=\s*[\"']?main\b", attrs):
            main, inner = main + 1, inner if inside else 0
        stack.append(held)
        opened[tag] += 1
        if tag in ("td", "th"):
            parts.append(" ")
    if place < len(html):
        rest = html[place:]
        cut = re.search(r"<[!?/a-zA-Z]", rest)
        parts.append(rest[:cut.start()] if cut else rest)
    end_line()
    return lines, zones


def text_zone(zones: list[int]) -> int:
    """The zone that holds the main text: the best marked one that has lines."""
    return min(zones, default=FRAMED)


def main_text(html: str, shared: frozenset[int] | set[int] = frozenset()) -> str:
    """The lines of the text zone, without the open lines numbered in `shared`."""
    lines, zones = lines_of(html)
    zone = text_zone(zones)
    if zone == FRAMED:
        return ""
    return "\n".join(x for i, (x, z) in enumerate(zip(lines, zones)) if z == zone and i not in shared)


def _lcs_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of `a` and each prefix of `b`: one bit per place of `b`, one addition
    of long integers per element of `a`."""
    n = len(b)
    places: dict[int, int] = {}
    for j, x in enumerate(b.tolist()):
        places[x] = places.get(x, 0) | 1 << j
    ones = (1 << n) - 1
    row = ones
    for x in a.tolist():
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & ones
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def common_lines(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Numbers of the elements of `a` in a longest common subsequence with `b`, by halving `a` where the lengths of both
    halves add up to the most; memory is linear in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append(i)
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append(j)
        if i == j or k == m:
            continue
        if j - i == 1:
            out += [i] if (b[k:m] == a[i]).any() else []
            continue
        half = (i + j) // 2
        cut = k + int(np.argmax(_lcs_row(a[i:half], b[k:m]) + _lcs_row(a[half:j][::-1], b[k:m][::-1])[::-1]))
        todo += [(i, half, k, cut), (half, j, cut, m)]
    return sorted(out)


def _common_part(path: str, other: str | None) -> int:
    """Steps that two URL paths share from their beginning; -1 for no page."""
    if other is None:
        return -1
    n = 0
    for x, y in zip(path.split("/"), other.split("/")):
        if x != y:
            break
        n += 1
    return n


def shared_lines(page: dict, before: dict | None, after: dict | None) -> list[int]:
    """Numbers of the lines of `page` that its nearest page in URL order shares; of equally near ones the one before is
    meant. A copy (`COPY`) is passed over for the other one, and without any there is nothing to tell."""
    near = sorted((x for x in (before, after) if x), key=lambda x: -_common_part(page["path"], x["path"]))
    lines, sizes = np.asarray(page["lines"], np.int64), np.asarray(page["sizes"], np.int64)
    for other in near:
        theirs = np.asarray(other["lines"], np.int64)
        both = common_lines(lines, theirs[np.isin(theirs, lines)])
        if sizes[both].sum() < COPY * max(sizes.sum(), sum(other["sizes"])):
            return both
    return []


def _url(url: Column) -> tuple[Column, Column]:
    """Host (lower case) and path of a URL, without query and fragment; a URL without `//` is a path alone."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    bare = F.regexp_replace(text, "[?#].*$", "")
    host = F.lower(F.regexp_extract(bare, "^(?:[^/]*:)?//([^/]*)", 1))
    return host, F.regexp_replace(bare, "^(?:[^/]*:)?//[^/]*", "")


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        rows = {"lines": [], "sizes": [], "open": []}
        for html in batch["html"].to_pylist():
            lines, zones = lines_of(html)
            rows["lines"].append([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in lines])
            rows["sizes"].append([len(x) for x in lines])
            rows["open"].append(text_zone(zones) == OPEN)
        columns = [pa.array(rows["lines"], pa.list_(pa.int64())), pa.array(rows["sizes"], pa.list_(pa.int32())), pa.array(rows["open"], pa.bool_())]
        yield pa.RecordBatch.from_arrays([batch["host"], batch["path"], batch["page"], *columns], ["host", "path", "page", "lines", "sizes", "open"])


def _page_key(url: Column, html: Column) -> Column:
    return F.struct(F.xxhash64(url).alias("u"), F.xxhash64(html).alias("a"), F.xxhash64(F.lit(1), html).alias("b"))


def page_differences(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page, shared): of pages whose text is not marked, the numbers of the lines that the page of the nearest URL on the
    same host shares; pages that share none have no row. `page` is `_page_key` of URL and html.

    Pages of one host with the same lines count once, as the one of least path, and share its result. All pages take
    part as partners. They are put in order by one range sort over all hosts, so that a host of any size is many tasks."""
    host, path = _url(F.col(url_col))
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(host.alias("host"), path.alias("path"), _page_key(F.col(url_col).cast("string"), html).alias("page"), html.alias("html"))
    schema = "host string, path string, page struct<u:long,a:long,b:long>, lines array<long>, sizes array<int>, open boolean"
    every = durable(rows.mapInArrow(_pages, schema).where(F.size("lines") > 0).withColumn("same", F.xxhash64("open", "lines")))
    heads = every.groupBy("host", "same").agg(F.min("path").alias("path"), F.first("lines").alias("lines"), F.first("sizes").alias("sizes"), F.first("open").alias("open"))
    placed = numbered(heads, [], ["host", "path", "same"], "at")
    side = F.struct("path", "lines", "sizes")
    before = placed.select((F.col("at") + 1).alias("at"), F.col("host").alias("host_before"), side.alias("before"))
    after = placed.select((F.col("at") - 1).alias("at"), F.col("host").alias("host_after"), side.alias("after"))
    wanted = placed.where("open").select("at", "host", "same", side.alias("own")).join(before.hint("merge"), "at", "left").join(after.hint("merge"), "at", "left")
    trio = wanted.select(
        "host", "same", "own", F.when(F.col("host") == F.col("host_before"), F.col("before")).alias("before"),
        F.when(F.col("host") == F.col("host_after"), F.col("after")).alias("after"),
    )

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, one, two = (batch[c].to_pylist() for c in ("own", "before", "after"))
            shared = pa.array([shared_lines(*x) for x in zip(own, one, two)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["host"], batch["same"], shared], ["host", "same", "shared"])

    found = durable(trio.mapInArrow(align, "host string, same long, shared array<int>").where(F.size("shared") > 0))
    out = durable(every.join(found, ["host", "same"]).select("page", "shared").dropDuplicates(["page"]))
    release(every, placed, found)
    return out


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text): the main text of each row of `pages`, one line per block, white space inside a line as one space.

    Marks decide first. Text inside `article` (or else `main`) elements is the main text, without the menus, footers,
    sidebars, notices, adverts, forms and comments marked inside it by element, role, class or id. A page without such an
    element has all its lines that no mark frames, less those that `page_differences` finds in the page of the nearest
    URL on its host. Lines of a marked article never go, whoever shares them. Scripts, styles and hidden parts give no
    text; a line break ends a line, a table cell does not. Unclosed elements end where HTML ends them, or with the page; an unfinished tag
    at the end of a page gives no text.

    Null and empty pages, and pages without text, give an empty text; null URLs are a host of their own; ids are only
    handed on. Rows equal in URL and html get the same text. An empty table gives an empty result; other columns are not
    read."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    page = _page_key(F.col(url_col).cast("string"), html)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), page.alias("page"), html.alias("html"))
    shared = page_differences(pages, url_col, html_col)
    joined = rows.join(shared, "page", "left").select("id", "url", "shared", "html")
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema}

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            pairs = zip(batch["html"].to_pylist(), batch["shared"].to_pylist())
            out = pa.array([main_text(h, set(s or ())) for h, s in pairs], pa.string())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["url"], out], ["id", "url", "text"])

    out = joined.mapInArrow(texts, f"id {kinds['id']}, url {kinds['url']}, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
