"""Master, line and ledger comparisons."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from checks import fixtures as fx
from checks.registry import query
from checks.scans import scratch
from tablematch.operators import ledger as lg
from tablematch.operators import ledger_run as lr
from tablematch.operators.cells import changed_columns, layout_of
from tablematch.operators.clean import data_columns, normalize
from tablematch.operators.lines import compare_lines, find_hot_keys, identical_lines, invoice_summary, leftover_lines
from tablematch.operators.master import compare_master, duplicates, inner_pairs, missing
from tablematch.plans.skew import first_rows
from tablematch.sources.readers import read_grid

KEYS = ["order_no"]


def or_none(name: str) -> F.Column:
    """Row number, -1 for none: keeps the column an integer in every client."""
    return F.coalesce(F.col(name), F.lit(-1).cast("long"))


def b1(spark, sf_dir):
    return normalize(fx.b1_source(spark, sf_dir)), normalize(fx.b1_target(spark, sf_dir))


def b1_comparison(spark, sf_dir):
    return compare_master(*b1(spark, sf_dir), KEYS, date="d", similar=False)


@query("C2_status_counts", fx.B1 + "SELECT status, count(*) AS n FROM rows GROUP BY 1")
def c2_status_counts(spark, sf_dir):
    return b1_comparison(spark, sf_dir).rows.groupBy("status").agg(F.count("*").alias("n"))


@query("C2_rows", fx.B1 + "SELECT order_no, status, nv + nf AS changed FROM rows")
def c2_rows(spark, sf_dir):
    return b1_comparison(spark, sf_dir).rows.select("order_no", "status", F.size(changed_columns()).cast("long").alias("changed"))


@query("C1_cell_diffs", fx.B1 + "SELECT order_no, column_name, source_value, target_value, kind FROM cells")
def c1_cell_diffs(spark, sf_dir):
    return b1_comparison(spark, sf_dir).rows.select("order_no", F.inline("diffs")).withColumnRenamed("column", "column_name")


@query("J1_deleted", fx.B1 + "SELECT order_no FROM rows WHERE status = 'Deleted'")
def j1_deleted(spark, sf_dir):
    s, t = b1(spark, sf_dir)
    return missing(s, t, KEYS).select("order_no")


@query("J1_added", fx.B1 + "SELECT order_no FROM rows WHERE status = 'Added'")
def j1_added(spark, sf_dir):
    s, t = b1(spark, sf_dir)
    return missing(t, s, KEYS).select("order_no")


@query("J2_pairs", fx.B1 + "SELECT order_no, s_amount, t_amount FROM pairs")
def j2_pairs(spark, sf_dir):
    s, t = b1(spark, sf_dir)
    return inner_pairs(s, t, KEYS).select("order_no", F.col("src.amount").alias("s_amount"), F.col("tgt.amount").alias("t_amount"))


@query("W1_duplicates", fx.B1 + "SELECT order_no, amount FROM dupt WHERE n > 1")
def w1_duplicates(spark, sf_dir):
    return duplicates(b1(spark, sf_dir)[1], KEYS).select("order_no", "amount")


@query("W2_first_per_key", fx.B1 + "SELECT order_no, amount FROM t1")
def w2_first_per_key(spark, sf_dir):
    return first_rows(b1(spark, sf_dir)[1], KEYS).select("order_no", "amount")


def b3(spark, sf_dir):
    s, t = fx.b3_tables(spark, sf_dir)
    return normalize(s), normalize(t)


@query("C3_status_counts", fx.B3 + "SELECT status, count(*) AS n FROM rows GROUP BY 1")
def c3_status_counts(spark, sf_dir):
    return compare_lines(*b3(spark, sf_dir), KEYS).rows.groupBy("status").agg(F.count("*").alias("n"))


@query("C3_pairs", fx.B3 + "SELECT order_no, coalesce(s_rid, -1) AS s_rid, coalesce(t_rid, -1) AS t_rid, status, changed FROM rows")
def c3_pairs(spark, sf_dir):
    return compare_lines(*b3(spark, sf_dir), KEYS).rows.select(
        "order_no", or_none("src._rid").alias("s_rid"), or_none("tgt._rid").alias("t_rid"), "status",
        F.size(changed_columns()).cast("long").alias("changed"),
    )


@query("J5_identical_lines", fx.B3 + "SELECT sr, tr FROM exact")
def j5_identical_lines(spark, sf_dir):
    s, t = b3(spark, sf_dir)
    layout = layout_of(data_columns(s), data_columns(t), KEYS)
    pairs = identical_lines(s, t, layout, find_hot_keys(s, t, layout), carry=[]).where("src is not null and tgt is not null")
    return pairs.select(F.col("src._rid").alias("sr"), F.col("tgt._rid").alias("tr"))


@query(
    "J6_positional_lines",
    fx.B3 + "SELECT coalesce(sr, -1) AS sr, coalesce(tr, -1) AS tr FROM links WHERE sr IS NULL OR tr IS NULL OR sr NOT IN (SELECT sr FROM exact)",
)
def j6_positional_lines(spark, sf_dir):
    s, t = b3(spark, sf_dir)
    layout = layout_of(data_columns(s), data_columns(t), KEYS)
    hot = find_hot_keys(s, t, layout)
    unpaired = identical_lines(s, t, layout, hot, carry=[]).where("src is null or tgt is null")
    return leftover_lines(unpaired, layout, hot).select(or_none("src._rid").alias("sr"), or_none("tgt._rid").alias("tr"))


@query(
    "A13_invoice_summary",
    fx.B3 + """SELECT 'price' AS amount_column, a AS source_invoice_total, b AS target_invoice_total, a - b AS invoice_difference FROM
    (SELECT CAST(sum(CAST(price AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS a FROM s0),
    (SELECT CAST(sum(CAST(replace(price, '$', '') AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS b FROM t0)""", double="source_invoice_total target_invoice_total invoice_difference")
def a13_invoice_summary(spark, sf_dir):
    out = invoice_summary(*b3(spark, sf_dir), "price")
    totals = [c for c in out.columns if c != "amount_column"]
    return out.select("amount_column", *[F.col(c).cast("double").alias(c) for c in totals])


def b2_ledger(spark, sf_dir):
    return lg.compare_ledger(fx.b2_source(spark, sf_dir), fx.b2_target(spark, sf_dir))


@query(
    "C4_rows",
    fx.B2 + """SELECT ns AS "TxnNumber_Source", nt AS "TxnNumber_Target", ty AS "TxnType", CAST(sa AS DOUBLE) AS "Amount_Source",
    CAST(ta AS DOUBLE) AS "Amount_Target", st AS "MatchStatus" FROM g""",
)
def c4_rows(spark, sf_dir):
    return b2_ledger(spark, sf_dir).groups.select(
        "TxnNumber_Source", "TxnNumber_Target", "TxnType", F.col("Amount_Source").cast("double").alias("Amount_Source"),
        F.col("Amount_Target").cast("double").alias("Amount_Target"), "MatchStatus",
    )


_PAGES = " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{b}' AS bucket, count(*) OVER () AS total, row_number() OVER (ORDER BY coalesce(ns, nt), ty, st, nt NULLS FIRST) AS place, ns, nt, ty, sa, ta FROM g WHERE st IN {s}) WHERE place <= 25"""
    for b, s in (("matched", "('Matched')"), ("disputed", "('Amount Mismatch')"), ("unmatched_source", "('Only In Source')"),
                 ("unmatched_target", "('Only In Target')"), ("tier2_rows", "('Tier2 Match', 'Tier2 Amount Mismatch')"))
)


@query("C4_grids_to_pages", fx.B2 + f""", p AS ({_PAGES}),
  ds AS (SELECT count(*) AS n FROM s JOIN sg ON s.num = sg.num AND s.ty = sg.ty WHERE sg.n > 1), dt AS (SELECT count(*) AS n FROM t JOIN tg ON t.num = tg.num AND t.ty = tg.ty WHERE tg.n > 1)
  SELECT bucket, total, place, ns AS number_source, nt AS number_target, ty AS type, sa AS amount_source, ta AS amount_target FROM p
  UNION ALL SELECT 'duplicate_source_rows', n, 0, NULL, NULL, NULL, NULL, NULL FROM ds UNION ALL SELECT 'duplicate_target_rows', n, 0, NULL, NULL, NULL, NULL, NULL FROM dt
  UNION ALL SELECT 'source_exceptions', 0, 0, NULL, NULL, NULL, NULL, NULL UNION ALL SELECT 'target_exceptions', 0, 0, NULL, NULL, NULL, NULL, NULL""",
       long="total place", double="amount_source amount_target")
def c4_grids(spark, sf_dir):
    """Two files with a banner and headers of their own, through headers, mapping and comparison, to nine buckets and first pages."""
    grids = []
    for side, rows, names in (("s", fx.b2_source, ["Invoice No", "Type", "Invoice Date", "Total Amount", "Customer Name"]), ("t", fx.b2_target, ["Document Number", "Doc Type", "Date", "Amount", "Client"])):
        path = scratch(spark, f"ledger-{side}")
        body = rows(spark, sf_dir).drop("_rid").select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(["TxnNumber", "TxnType", "TxnDate", "Amount", "Customer"])])
        head = spark.createDataFrame([("Ledger export", "", "", "", ""), tuple(names)], body.schema)
        head.coalesce(1).unionByName(body).write.csv(path)  # the head is the first partition and so the first file
        grids.append(read_grid(spark, path))
    run = lr.compare_grids(*grids)
    out = run.totals().where(~F.col("bucket").isin(*lr.STATUSES)).select("bucket", "total", F.lit(0).cast("long").alias("place"), *[F.lit(None).cast(t).alias(c) for c, t in _PAGE])
    for bucket in lr.STATUSES:
        page = run.page(bucket, page=1, page_size=25)
        place = F.row_number().over(Window.partitionBy(F.lit(bucket)).orderBy("_rid")).cast("long")  # the 25 rows of a page
        rows = page.items.withColumns({"bucket": F.lit(bucket), "total": F.lit(page.total).cast("long"), "place": place})
        out = out.union(rows.select("bucket", "total", "place", "TxnNumber_Source", "TxnNumber_Target", "TxnType", F.col("Amount_Source").cast("double"), F.col("Amount_Target").cast("double")))
    return out


_PAGE = [("number_source", "string"), ("number_target", "string"), ("type", "string"), ("amount_source", "double"), ("amount_target", "double")]


@query(
    "J4_tier2",
    fx.B2 + """SELECT ns AS "TxnNumber_Source", nt AS "TxnNumber_Target", ty AS "TxnType", st AS "MatchStatus" FROM tier2""",
)
def j4_tier2(spark, sf_dir):
    s, t = fx.b2_source(spark, sf_dir), fx.b2_target(spark, sf_dir)
    groups = lg.outer_groups(s, t, 0.01)
    return lg.suffix_matches(groups, 0.01).select("TxnNumber_Source", "TxnNumber_Target", "TxnType", "MatchStatus")


@query(
    "J3_outer_groups",
    fx.B2 + """SELECT num AS "TxnNumber", ty AS "TxnType", CAST(sa - ta AS DOUBLE) AS "Diff", st AS "MatchStatus" FROM j""",
)
def j3_outer_groups(spark, sf_dir):
    groups = lg.outer_groups(fx.b2_source(spark, sf_dir), fx.b2_target(spark, sf_dir), 0.01)
    return groups.select("TxnNumber", "TxnType", F.col("Diff").cast("double").alias("Diff"), "MatchStatus")


@query(
    "A12_ledger_summary",
    fx.B2 + """, m AS (
  SELECT 'source_records' AS metric, count(*) AS v FROM sg UNION ALL SELECT 'target_records', count(*) FROM tg
  UNION ALL SELECT 'duplicate_keys_source', sum(n) FILTER (n > 1) FROM sg UNION ALL SELECT 'duplicate_keys_target', sum(n) FILTER (n > 1) FROM tg
  UNION ALL SELECT 'source_invoice_total', sum(a) FROM sg UNION ALL SELECT 'target_invoice_total', sum(a) FROM tg
  UNION ALL SELECT 'source_total', sum(a) FROM sg UNION ALL SELECT 'target_total', sum(a) FROM tg
  UNION ALL SELECT 'matched', count(*) FROM g WHERE st = 'Matched' UNION ALL SELECT 'amount_mismatch', count(*) FROM g WHERE st = 'Amount Mismatch'
  UNION ALL SELECT 'only_in_source', count(*) FROM g WHERE st = 'Only In Source' UNION ALL SELECT 'only_in_target', count(*) FROM g WHERE st = 'Only In Target'
  UNION ALL SELECT 'tier2_matches', count(*) FROM tier2
  UNION ALL SELECT 'invoice_difference', (SELECT sum(a) FROM sg) - (SELECT sum(a) FROM tg)
  UNION ALL SELECT 'net_diff', (SELECT sum(a) FROM sg) - (SELECT sum(a) FROM tg)
  UNION ALL SELECT 'source_exceptions', 0 UNION ALL SELECT 'target_exceptions', 0)
SELECT metric, CAST(v AS DOUBLE) AS value FROM m""",
)
def a12_ledger_summary(spark, sf_dir):
    return lg.ledger_summary(b2_ledger(spark, sf_dir)).select("metric", F.col("value").cast("double").alias("value"))
