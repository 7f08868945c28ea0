"""Line dedup: a suffix array over the lines of all documents, by prefix doubling.

Each line has a place (document, number). The name of a place at some depth is the first place from which the same lines
stand, so equal names are one interval of the suffix array with a common prefix of that depth. Depth doubles by pairing
the names of two places; places that nothing shares are dropped before the next round. At depth `min_lines` a place whose
name is an earlier place begins a later copy; what such places cover are all lines of repeated runs, where adjoining runs make one stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablematch.llm.common import keyed, same_key
from tablematch.plans.skew import durable, release

MIN_LINES = 2


def _place(line: str) -> Column:
    """Order of documents (by id, null last, then by text hash) and lines as one number, which hash aggregates can hold."""
    doc = F.coalesce(F.col("_id").cast("decimal(20,0)"), F.lit("1e19").cast("decimal(20,0)")).cast("decimal(38,0)")
    rest = F.pmod("_h", F.lit(10**8)).cast("decimal(18,0)") * F.lit(10**10).cast("decimal(12,0)") + F.col(line).cast("decimal(10,0)")
    return (doc * F.lit(10**18).cast("decimal(19,0)") + rest).cast("decimal(38,0)")


def _named(rows: DataFrame, by: list[str]) -> DataFrame:
    """Places whose `by` another place has too, with their name. Combined before the shuffle; the names are a table of one
    row per group, so that the join back can split a very frequent group."""
    names = durable(rows.groupBy(*by).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    named = durable(rows.join(names, by).select("_id", "_h", "line", "place", F.col("first").alias("name")))
    release(names)
    return named


def repeated_places(docs: DataFrame, min_lines: int) -> DataFrame:
    """(_id, _h, line): places that begin a later copy of `min_lines` lines in `docs` (see `keyed`)."""
    ids = F.transform(F.split("_text", "\n"), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    lines = docs.select("_id", "_h", F.posexplode(ids).alias("line", "x")).select("_id", "_h", "line", "x.a", "x.b")
    places = _named(lines.withColumn("place", _place("line")), ["a", "b"])
    depth = 1
    while depth < min_lines:
        step = min(depth, min_lines - depth)
        ahead = Window.partitionBy("_id", "_h").orderBy("line").rangeBetween(step, step)
        pairs = durable(places.withColumn("next", F.min("name").over(ahead)).where("next IS NOT NULL"))
        after = _named(pairs, ["name", "next"])
        release(places, pairs)
        places, depth = after, depth + step
    return places.where("name < place").select("_id", "_h", "line")


def remove_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES,
) -> DataFrame:
    """(id, n_lines, n_removed, n_runs, longest_run, kept_text): each text without the later copies of runs of lines.

    Lines are what stands between line feeds, compared exactly. A line goes if it lies in a run of `min_lines` lines or
    more that also stands earlier: in a document of smaller id, or further up. Runs are judged on the texts as given.
    `n_runs` and `longest_run` tell the stretches of lines that went: adjoining runs copied from two places are one stretch. Ids are integers; null ids come last. Rows equal in id and
    text are one document and get the same result; rows of one id with different texts are ordered by their hash. A null
    text is one empty line; an empty table gives an empty result; other columns are not read."""
    out = _without(keyed(docs, id_col, text_col), min_lines)
    lengths = F.zip_with("heads", "tails", lambda a, b: b - a + 1)
    return out.select(
        F.col("_id").alias(id_col), F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"),
        F.size("heads").cast("long").alias("n_runs"), F.coalesce(F.array_max(lengths), F.lit(0)).cast("long").alias("longest_run"),
        F.col("kept").alias("kept_text"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """`docs` with all rows and columns, but the text without the lines that `remove_repeated_lines` removes."""
    rest = [c for c in docs.columns if c != text_col]
    out = _without(keyed(docs, id_col, text_col, F.struct(*rest).alias("_rest")), min_lines)
    return out.select(*[F.col("kept").alias(c) if c == text_col else F.col("_rest")[c].alias(c) for c in docs.columns])


def _without(rows: DataFrame, min_lines: int) -> DataFrame:
    """`rows` (see `keyed`) with lines, numbers of those to go, heads and tails of the runs they form, and the text kept."""
    if min_lines < 1:
        raise ValueError("a run has one line at least")
    places = repeated_places(rows.select("_id", "_h", "_text"), min_lines)
    starts = durable(places.groupBy("_id", "_h").agg(F.collect_set("line").alias("starts")))
    covered = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.lit(min_lines - 1))))
    rest = [c for c in rows.columns if c not in ("_id", "_h", "_text")]
    return (
        rows.join(starts.hint("merge"), same_key(rows, starts), "left")  # grows with the documents: one plan at every size
        .select(rows["_id"], *rest, F.split("_text", "\n").alias("lines"), F.sort_array(F.array_distinct(covered)).alias("gone"))
        .withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
        .withColumn("left", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")))
        .withColumn("heads", F.filter("gone", lambda x, j: F.coalesce(F.get("gone", j - 1) < x - 1, F.lit(True))))
        .withColumn("tails", F.filter("gone", lambda x, j: F.coalesce(F.get("gone", j + 1) > x + 1, F.lit(True))))
        .withColumn("kept", F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n"))
    )


SQL = """
WITH l AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i
    FROM documents
), pairs AS (
    SELECT doc_id, i, line AS a, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM l
), places AS MATERIALIZED (
    SELECT *, doc_id::HUGEINT * 10000000000 + i AS place FROM pairs WHERE b IS NOT NULL
), firsts AS (
    SELECT a, b, min(place) AS place FROM places GROUP BY a, b
), later AS MATERIALIZED (
    SELECT p.doc_id, p.i FROM places p JOIN firsts f USING (a, b) WHERE f.place < p.place
), gone AS MATERIALIZED (
    SELECT doc_id, i FROM later UNION SELECT doc_id, i + 1 FROM later
), runs AS (
    SELECT doc_id, count(*) AS n FROM (SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM gone)
    GROUP BY doc_id, run
), by_doc AS (
    SELECT doc_id, count(*) AS n_runs, max(n) AS longest_run FROM runs GROUP BY doc_id
)
SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, coalesce(any_value(n_runs), 0) AS n_runs,
       coalesce(any_value(longest_run), 0) AS longest_run,
       coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL), '') AS kept_text
FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i LEFT JOIN by_doc ON by_doc.doc_id = l.doc_id
GROUP BY l.doc_id
"""
