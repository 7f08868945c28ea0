"""Operators that larger queries use, each on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.comparisons import b1, b1_comparison, b3
from checks.registry import query
from checks.scans import FIELDS, grid_file, stage_two_batches
from checks.series import METRICS, chain
from tablematch.config import DEFAULTS
from tablematch.functions import text as tx
from tablematch.functions import validate as vd
from tablematch.functions import values as vl
from tablematch.operators import align as al
from tablematch.operators import days as dy
from tablematch.operators import ledger as lg
from tablematch.operators import metrics as mt
from tablematch.operators import schema_match as sm
from tablematch.operators import search as se
from tablematch.operators.cells import layout_of
from tablematch.operators.clean import data_columns
from tablematch.operators.lines import find_hot_keys
from tablematch.plans.skew import ranked
from tablematch.sources import readers as rd


SNK1_SQL = """SELECT 'b1' AS batch_id, 'c_custkey' AS business_key, 'p' AS project_name, '{"c_custkey":' || c_custkey || '}' AS row_data FROM customer
UNION ALL SELECT 'b2', 'c_custkey', 'p', '{"c_custkey":' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN ',"c_name":"' || c_name || '"' ELSE '' END
  || ',"c_mktsegment":"' || c_mktsegment || '"}' FROM customer"""


@query("SNK1_stage_rows", SNK1_SQL)
def snk1(spark, sf_dir):
    return stage_two_batches(spark, sf_dir).select("batch_id", "business_key", "project_name", "row_data")


@query("SRC5_records_to_columns", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def src5(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select("event_id", "props")
    return rd.records_to_columns(e, ["k"], "props", keep=("event_id",))


@query("P5_promote_header", """SELECT CAST(o_orderkey AS VARCHAR) AS "Order No", CAST(o_custkey AS VARCHAR) AS "Customer" FROM orders UNION ALL SELECT 'order', 'cust'""")
def p5(spark, sf_dir):
    return al.promote_header(rd.read_grid(spark, grid_file(spark, sf_dir)), 1).select("Order No", "Customer")


@query("P13_canonical_projection", """SELECT CAST(o_orderkey AS VARCHAR) AS "TxnNumber", CAST(NULL AS VARCHAR) AS "TxnType", CAST(o_orderdate AS DATE) AS "TxnDate", CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS "Amount", CAST(NULL AS VARCHAR) AS "Customer" FROM orders""")
def p13(spark, sf_dir):
    out = al.apply_mapping(fx.b1_source(spark, sf_dir), {"TxnNumber": "order_no", "TxnType": None, "TxnDate": "d", "Amount": "amount", "Customer": "absent"})
    return out.drop("_rid").withColumn("Amount", F.col("Amount").cast("double"))


@query("P16_loose_columns", "SELECT CAST(o_totalprice AS DECIMAL(18,2)) AS mine, CAST(o_totalprice AS DECIMAL(18,2)) AS theirs FROM orders", double="mine theirs")
def p16(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select(fx.money("o_totalprice").alias("Total-Price X"), fx.money("o_totalprice").alias("total_pricex"))
    mine, theirs = al.loose_pairs(["Total-Price X"], ["other", "total_pricex"])[0]
    return o.select(F.col(f"`{mine}`").cast("double").alias("mine"), F.col(theirs).cast("double").alias("theirs"))


@query("F6_required_fields", """SELECT count(*) AS n, count(*) AS with_number, count(*) AS with_amount FROM orders""")
def f6(spark, sf_dir):
    """The gate passes, and the required fields are there in every row."""
    table, decisions = al.load_and_map(rd.read_grid(spark, grid_file(spark, sf_dir)), FIELDS)
    lg.require_fields(al.as_mapping(decisions))
    return table.agg(F.count("*").alias("n"), F.count("TxnNumber").alias("with_number"), F.count("Amount").alias("with_amount"))


@query("F7_drop_future_days", f"SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '{fx.AS_OF}' GROUP BY 1")
def f7(spark, sf_dir):
    days = fx.b1_source(spark, sf_dir).groupBy(vl.day_of(F.col("d")).alias("day")).agg(F.count("*").alias("n"))
    return dy.drop_future(days, fx.AS_OF)


@query("U1_full_comparison", fx.B1 + "SELECT order_no, count(*) AS n FROM rows GROUP BY 1")
def u1(spark, sf_dir):
    """Every record of both tables is in the union exactly as often as it should."""
    return b1_comparison(spark, sf_dir).rows.groupBy("order_no").agg(F.count("*").alias("n"))


@query("U2_union_of_days", fx.B1 + "SELECT DISTINCT d AS day FROM (SELECT d FROM b1s UNION ALL SELECT d FROM b1t)")
def u2(spark, sf_dir):
    """The days of both tables, as the summary by day lists them."""
    return dy.day_summary(b1_comparison(spark, sf_dir), "2100-01-01").select("day").distinct()


@query("U3_key_intersection", fx.B2 + "SELECT stem, ty FROM o2 WHERE st = 'Only In Source' INTERSECT SELECT stem, ty FROM o2 WHERE st = 'Only In Target'")
def u3(spark, sf_dir):
    groups = lg.outer_groups(fx.b2_source(spark, sf_dir), fx.b2_target(spark, sf_dir), 0.01)
    stems = lambda side: groups.where(F.col("MatchStatus") == side).select(tx.strip_suffix(F.col("TxnNumber")).alias("stem"), F.col("TxnType").alias("ty"))
    return stems("Only In Source").intersect(stems("Only In Target"))


@query("U4_value_jaccard", """WITH a AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS v FROM orders), b AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS v FROM customer)
  SELECT round((SELECT count(*) FROM a JOIN b USING (v)) * 1.0 / (SELECT count(*) FROM (SELECT v FROM a UNION SELECT v FROM b)), 6) AS overlap""")
def u4(spark, sf_dir):
    """Customers that order against all customers: the leading rows share next to nothing."""
    o = fx.table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("_rid"))
    c = fx.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("_rid"))
    return sm.value_overlap(o, c).select(F.round("overlap", 6).alias("overlap"))


@query("U5_column_difference", "SELECT 'amount' AS compared, count(*) AS n FROM orders UNION ALL SELECT 'source only: status', count(*) FROM orders")
def u5(spark, sf_dir):
    s = fx.b1_source(spark, sf_dir).select("order_no", "amount", "status")
    layout = layout_of(s.columns, ["order_no", "amount"], ["order_no"])
    labels = layout.compare + [f"source only: {c}" for c in layout.source_only]
    return s.select(F.explode(F.array(*[F.lit(c) for c in labels])).alias("compared")).groupBy("compared").agg(F.count("*").alias("n"))


@query("W4_occurrence_number", fx.B3 + "SELECT order_no, line, row_number() OVER (PARTITION BY order_no, line ORDER BY rid) AS n, rid FROM s0")
def w4(spark, sf_dir):
    s, t = b3(spark, sf_dir)
    hot = find_hot_keys(s, t, layout_of(data_columns(s), data_columns(t), ["order_no"]))
    out = ranked(s, ["order_no", "line"], "_rid", "n", hot, ["order_no"])
    return out.select("order_no", "line", "n", F.col("_rid").alias("rid"))


@query("W6_quality_delta", METRICS + "SELECT version, round(quality - lag(quality) OVER (ORDER BY version), 6) AS quality_delta FROM m")
def w6(spark, sf_dir):
    return mt.run_metrics(chain(spark, sf_dir).versions()).select("version", F.round("quality_delta", 6).alias("quality_delta"))


@query("S4_clean_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def s4(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate").cast("date")
    t = (
        F.when(k == 0, "2024-13-41").when(k == 1, F.date_format(d, "M/d/yyyy")).when(k == 2, F.date_format(d, "MMM d, yyyy"))
        .when(k == 3, F.date_format(d, "yyyy/MM/dd HH:mm")).otherwise(F.date_format(d, "dd-MMMM-yyyy"))
    )
    return o.select("o_orderkey", vl.parse_date(t).alias("day"))


@query("S10_lenient_amount", "SELECT CAST(sum(CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS total FROM orders")
def s10(spark, sf_dir):
    t = F.when(F.col("o_orderkey") % 3 == 0, "void").otherwise(F.concat(F.lit("$"), F.format_number(fx.money("o_totalprice"), 2)))
    return fx.table(spark, sf_dir, "orders").agg(F.sum(vl.lenient_amount(t)).cast("double").alias("total"))


@query("S11_tolerance", "SELECT count(*) FILTER (l_orderkey % 3 = 0) AS outside, count(*) FILTER (l_orderkey % 3 <> 0) AS inside FROM lineitem")
def s11(spark, sf_dir):
    gap = F.when(F.col("l_orderkey") % 3 == 0, F.expr("0.02")).otherwise(F.expr("0.01"))
    a = fx.money("l_extendedprice")
    ok = vl.within_tolerance(a, a + gap, DEFAULTS.amount_tolerance)
    return fx.table(spark, sf_dir, "lineitem").agg(F.count_if(~ok).alias("outside"), F.count_if(ok).alias("inside"))


@query("S13_confidence_band", "SELECT CASE WHEN l_discount * 10 >= 0.85 THEN 'VERY HIGH' WHEN l_discount * 10 >= 0.70 THEN 'HIGH' WHEN l_discount * 10 >= 0.50 THEN 'NEEDS REVIEW' ELSE 'LOW' END AS band, count(*) AS n FROM lineitem GROUP BY 1")
def s13(spark, sf_dir):
    return fx.table(spark, sf_dir, "lineitem").groupBy(tx.confidence_band(F.col("l_discount") * 10).alias("band")).agg(F.count("*").alias("n"))


@query("S14_validators", """SELECT 'date' AS kind, round(avg(CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END), 6) AS share FROM (SELECT o_orderkey AS k FROM orders)
  UNION ALL SELECT 'email', round(avg(CASE WHEN k % 4 = 1 THEN 1 ELSE 0 END), 6) FROM (SELECT o_orderkey AS k FROM orders)
  UNION ALL SELECT 'phone', round(avg(CASE WHEN k % 4 IN (0, 2) THEN 1 ELSE 0 END), 6) FROM (SELECT o_orderkey AS k FROM orders)
  UNION ALL SELECT 'currency', round(avg(CASE WHEN k % 4 = 3 THEN 1 ELSE 0 END), 6) FROM (SELECT o_orderkey AS k FROM orders)
  UNION ALL SELECT 'numeric', round(avg(CASE WHEN k % 4 IN (1, 2) THEN 1 ELSE 0 END), 6) FROM (SELECT o_orderkey AS k FROM orders)
  UNION ALL SELECT 'identifier', 0.0 UNION ALL SELECT 'identifier of keys', round(count(DISTINCT k // 20 * 20 + greatest(k % 20, 1)) / count(*), 6) FROM (SELECT o_orderkey AS k FROM orders)
  UNION ALL SELECT 'identifier of names', 0.0""", double="share")
def s14(spark, sf_dir):
    """All six validators on a column of four kinds of texts; keys of which one in twenty comes twice; names with blanks."""
    k = F.col("o_orderkey") % 4
    t = (
        F.when(k == 0, F.col("o_orderdate").cast("date").cast("string")).when(k == 1, F.concat(F.lit("a"), F.col("o_orderkey").cast("string"), F.lit("@x.org")))
        .when(k == 2, F.concat(F.lit("+49 (30) "), F.lpad(F.col("o_orderkey").cast("string"), 8, "1"))).otherwise("EUR")
    )
    key = F.concat(F.lit("K-"), (F.floor(F.col("o_orderkey") / 20) * 20 + F.greatest(F.col("o_orderkey") % 20, F.lit(1))).cast("string"))
    scores = vd.validator_scores(F.col("t"))
    shares = {c: scores[c] for c in ("date", "email", "phone", "currency", "numeric", "identifier")}
    shares |= {"identifier of keys": vd.validator_scores(F.col("key"))["identifier"], "identifier of names": vd.validator_scores(F.col("name"))["identifier"]}
    rows = fx.table(spark, sf_dir, "orders").select(t.alias("t"), key.alias("key"), F.concat(F.lit("order "), key).alias("name"))
    wide = rows.agg(*[F.round(v, 6).alias(c) for c, v in shares.items()])
    return wide.unpivot([], list(shares), "kind", "share")


@query("S18_percent", "SELECT l_orderkey, round(100.0 * count(*) FILTER (l_returnflag = 'R') / count(*), 1) AS share FROM lineitem GROUP BY 1")
def s18(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey").agg(vl.percent(F.count_if(F.col("l_returnflag") == "R"), F.count("*")).alias("share"))


@query("S20_signed_difference", """SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN a ELSE -a END AS DOUBLE) AS gap FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS a FROM orders)""")
def s20(spark, sf_dir):
    a, k = fx.money("o_totalprice"), F.col("o_orderkey") % 3
    gap = vl.signed_difference(a, F.when(k == 0, a - 1).otherwise(a), k != 2, k != 1)
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", gap.cast("double").alias("gap"))


@query("A2_type_usable", "SELECT true AS both, false AS one, count(*) AS n FROM lineitem")
def a2(spark, sf_dir):
    s = fx.b2_source(spark, sf_dir)
    bare = s.withColumn("TxnType", F.lit(None).cast("string"))
    return s.agg(F.count("*").alias("n")).withColumn("both", F.lit(lg.type_usable(s, s))).withColumn("one", F.lit(lg.type_usable(s, bare)))


@query("L2_page_size", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 25")
def l2(spark, sf_dir):
    """A requested size of 12 becomes the smallest offered one."""
    c = fx.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("_rid"))
    return se.paginate(c, page_size=12).items.select("c_custkey")
