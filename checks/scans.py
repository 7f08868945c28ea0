"""Scans, cleaning, cell functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.registry import query
from tablematch.functions import text as tx
from tablematch.functions import values as vl
from tablematch.operators import align as al
from tablematch.operators import clean as cl
from tablematch.plans.skew import work_folder
from tablematch.sources import catalog as ct
from tablematch.sources import readers as rd
from tablematch.sources import workbook as wb
from tablematch.sources.ordinal import internal_id, with_ordinal, with_ordinal_by
from tablematch.sources.text_chunks import chunk_records, chunk_rows

ORDERS_TEXT = f"WITH {fx.SQL_ORDERS}, {fx.SQL_B1_SOURCE}, {fx.sql_b1_target()}\n"


def scratch(spark, name: str) -> str:
    """New folder for the files of one query."""
    return f"{work_folder(spark)}/checks/{uuid.uuid4().hex}/{name}"


def orders_csv(spark, sf_dir, header: bool = True) -> str:
    path = scratch(spark, "orders")
    fx.b1_source(spark, sf_dir).drop("_rid").repartition(3, "order_no").write.option("header", header).csv(path)
    return path


@query("SRC1_read_strings", ORDERS_TEXT + "SELECT order_no, cust, status, amount, d FROM b1s")
def src1(spark, sf_dir):
    return rd.read_strings(spark, orders_csv(spark, sf_dir), ordinal=False)


@query("SRC1_quoted_records", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS rid, CAST(doc_id AS VARCHAR) AS id, text, lang, source FROM documents")
def src1_quoted(spark, sf_dir):
    """Texts with commas, quotes and line breaks in many quoted cells, written in order and read split by split."""
    path = scratch(spark, "quoted")
    docs = fx.table(spark, sf_dir, "documents").orderBy("doc_id").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    exact = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    docs.write.options(**exact).csv(path)
    return rd.read_strings(spark, path, multi_line=True).withColumnRenamed("_rid", "rid")


@query("W3_ordinal", "SELECT CAST(o_orderkey AS VARCHAR) AS order_no, CAST(o_custkey AS VARCHAR) AS cust, row_number() OVER (ORDER BY o_orderkey) - 1 AS rid FROM orders")
def w3(spark, sf_dir):
    path = scratch(spark, "ordered")
    fx.b1_source(spark, sf_dir).orderBy("_rid").drop("_rid").write.option("header", True).csv(path)
    return with_ordinal(spark.read.option("header", True).csv(path)).select("order_no", "cust", F.col("_rid").alias("rid"))


@query(
    "W3_ordinal_by",
    "SELECT c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS rid, 'SRC_' || (row_number() OVER (ORDER BY c_name, c_custkey) - 1) AS internal_id FROM customer",
)
def w3_by(spark, sf_dir):
    rows = with_ordinal_by(fx.table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"])
    return rows.select("c_custkey", F.col("_rid").alias("rid"), internal_id("SRC").alias("internal_id"))


FIELDS = {
    "TxnNumber": ["orderno", "order"], "TxnType": ["status", "type"], "TxnDate": ["orderdate", "date"],
    "Amount": ["amount", "total"], "Customer": ["customer", "cust"],
}


def grid_file(spark, sf_dir) -> str:
    """B9: banner row, header row, second header row, then the orders; one file, so that the order is fixed."""
    path = scratch(spark, "grid")
    head = [("Order export", "", "", "", ""), ("Order No", "Customer", "Status", "Amount", "Order Date"), ("order", "cust", "type", "total", "date")]
    top = spark.createDataFrame([(-3 + i, *r) for i, r in enumerate(head)], "_rid long, order_no string, cust string, status string, amount string, d string")
    body = fx.b1_source(spark, sf_dir)
    top.unionByName(body).orderBy("_rid").drop("_rid").write.option("header", False).csv(path)
    return path


@query("SRC2_read_grid", ORDERS_TEXT + """SELECT 0 AS _rid, 'Order export' AS _c0, NULL AS _c1, NULL AS _c2, NULL AS _c3, NULL AS _c4
UNION ALL SELECT 1, 'Order No', 'Customer', 'Status', 'Amount', 'Order Date' UNION ALL SELECT 2, 'order', 'cust', 'type', 'total', 'date'
UNION ALL SELECT 2 + row_number() OVER (ORDER BY rid), order_no, cust, status, amount, d FROM b1s""", long="_rid")
def src2(spark, sf_dir):
    return rd.read_grid(spark, grid_file(spark, sf_dir))


@query("SRC2_workbook", ORDERS_TEXT + """SELECT 0 AS _rid, 'Order No' AS _c0, 'Customer' AS _c1, 'Status' AS _c2, 'Amount' AS _c3, 'Order Date' AS _c4
UNION ALL SELECT row_number() OVER (ORDER BY rid), order_no, cust, status, rtrim(rtrim(amount, '0'), '.'), d FROM b1s""", long="_rid")
def src2_workbook(spark, sf_dir):
    """The orders as a workbook, amounts as numbers, read in blocks of 4000 rows."""
    path = scratch(spark, "workbook")
    rows = fx.b1_source(spark, sf_dir).orderBy("_rid").drop("_rid").withColumn("amount", F.col("amount").cast("double"))
    wb.write_workbooks(rows.toDF("Order No", "Customer", "Status", "Amount", "Order Date").coalesce(1), path)
    return wb.read_workbook(spark, path, sheet="*", block=4000)


@query(
    "P14_load_and_map",
    ORDERS_TEXT + """SELECT order_no AS "TxnNumber", status AS "TxnType", CAST(d AS DATE) AS "TxnDate", CAST(amount AS DOUBLE) AS "Amount", cust AS "Customer" FROM b1s""",
)
def p14(spark, sf_dir):
    """Grid scan, header detection, promotion, empty columns/rows, repeated header, mapping (P-4 to P-6, P-11, P-13)."""
    table, _ = al.load_and_map(rd.read_grid(spark, grid_file(spark, sf_dir)), FIELDS)
    return table.select("TxnNumber", "TxnType", "TxnDate", F.col("Amount").cast("double").alias("Amount"), "Customer")


@query("P4_header_row", "SELECT 1 AS header_row, count(*) + 1 AS rows_below FROM orders", long="header_row")
def p4(spark, sf_dir):
    grid = rd.read_grid(spark, grid_file(spark, sf_dir))
    row = al.detect_header_row(grid, FIELDS)
    return al.promote_header(grid, row).agg(F.lit(row).cast("long").alias("header_row"), F.count("*").alias("rows_below"))


@query("P6_repeated_header", "SELECT count(*) AS n, 0 AS labels FROM orders", long="labels")
def p6(spark, sf_dir):
    table = al.promote_header(rd.read_grid(spark, grid_file(spark, sf_dir)), 1)
    kept = al.drop_repeated_header(table, FIELDS)
    return kept.agg(F.count("*").alias("n"), F.count_if(F.col("Amount") == "total").alias("labels"))


@query("P1_normalize", """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, trim(c_name) AS name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
  coalesce(CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END, '') AS segment FROM customer""")
def p1(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer")
    raw = c.select(
        "c_custkey", F.concat(F.lit(" "), "c_name", F.lit("  ")).alias(" name "), "c_nationkey",
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("segment"),
    )
    return cl.normalize(raw)


@query("P2_drop_unnamed", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'x' END AS _c2 FROM customer")
def p2(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer")
    raw = c.select(
        "c_custkey", F.when(F.col("c_custkey") % 50 == 0, "x").alias("Unnamed: 1"), F.when(F.col("c_custkey") % 2 == 0, "x").alias("_c2")
    )
    return cl.drop_unnamed(raw)


@query("P3_drop_empty", "SELECT c_name FROM customer WHERE c_custkey % 3 <> 0")
def p3(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer")
    raw = c.select(F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("c_name"), F.lit(" ").alias("nothing"))
    return cl.drop_empty_rows(cl.drop_empty_columns(raw))


@query("P7_column_names", "SELECT lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS flat, count(*) AS n FROM part GROUP BY 1")
def p7(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").groupBy(tx.lookup_text(F.col("p_brand")).alias("flat")).agg(F.count("*").alias("n"))


@query("P8_align_equivalent", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def p8(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    target = c.toDF("CCustKey", "C Name", "c-mkt-segment")
    return target.withColumnsRenamed(al.equivalent_renames(c.columns, target.columns))


@query("P9_manual_mapping", "SELECT c_custkey, c_name, c_mktsegment AS seg FROM customer")
def p9(spark, sf_dir):
    target = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("n"), F.col("c_mktsegment").alias("seg"))
    return target.withColumnsRenamed(al.manual_renames(target.columns, {"c_custkey": "k", "c_name": "n", "c_mktsegment": "__ignore__"}))


@query("P10_similar_columns", "SELECT c_custkey AS address1_original, c_name AS phone_number, c_mktsegment AS segment FROM customer")
def p10(spark, sf_dir):
    target = fx.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ADDRESS1"), F.col("c_name").alias("phonenumbr"), F.col("c_mktsegment").alias("segment")
    )
    return al.align(spark.createDataFrame([], "address1_original string, phone_number string, segment string"), target)


@query("P11_datatype_tier", """SELECT CAST(o_orderkey AS VARCHAR) AS "TxnNumber", CAST(o_orderdate AS DATE) AS "TxnDate", CAST(o_totalprice AS DOUBLE) AS "Amount" FROM orders""")
def p11(spark, sf_dir):
    """Headers say nothing: number, date and amount are found by their sampled values."""
    raw = fx.b1_source(spark, sf_dir).select(F.col("d").alias("f1"), F.concat(F.lit("N/"), "order_no").alias("f2"), F.concat(F.lit("$ "), "amount").alias("f3"), "_rid")
    fields = {"TxnDate": ["orderdate"], "TxnNumber": ["orderno"], "Amount": ["total"]}
    decisions = al.map_columns(["f1", "f2", "f3"], fields, {"Amount": "f3"}, raw)
    out = al.apply_mapping(raw, al.as_mapping(decisions))
    return out.select(F.substring("TxnNumber", 3, 99).alias("TxnNumber"), "TxnDate", F.col("Amount").cast("double").alias("Amount"))


@query("P12_fuzzy_mapping", """SELECT CAST(o_orderkey AS VARCHAR) AS "TxnNumber", CAST(o_custkey AS VARCHAR) AS "Customer" FROM orders""")
def p12(spark, sf_dir):
    raw = fx.b1_source(spark, sf_dir).select(F.col("order_no").alias("Order Numbr"), F.col("cust").alias("Customer Name (bill to only)"), "_rid")
    decisions = al.map_columns(cl.data_columns(raw), {"TxnNumber": ["ordernumber"], "Customer": ["customername"]}, method="fuzzy")
    return al.apply_mapping(raw, al.as_mapping(decisions)).drop("_rid")


@query("P15_missing_key", "SELECT c_custkey, '' AS region, c_name FROM customer")
def p15(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return cl.add_missing_keys(c, c.withColumn("region", F.lit("x")), ["region"])[0]


@query("P17_amount_column", "SELECT sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total, 'o_totalprice' AS column_name FROM orders", double="total")
def p17(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    name = al.amount_like(o.columns)
    return o.agg(F.sum(fx.money(name)).cast("double").alias("total"), F.lit(name).alias("column_name"))


@query("P18_schema_difference", """SELECT 'Source-only column' AS type, 'l_tax' AS column_name, (SELECT sum(CAST(l_tax AS DECIMAL(18,2))) FROM lineitem) AS total
  UNION ALL SELECT 'Target-only column', 'l_extra', (SELECT count(*) FROM lineitem)""", double="total")
def p18(spark, sf_dir):
    """Differences joined to a total over the data of the columns they name."""
    source = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_tax")
    target = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", F.lit(1).alias("l_extra"))
    diff = al.schema_difference(spark, source.columns, target.columns)
    sums = source.agg(F.sum(fx.money("l_tax")).alias("total")).select(F.lit("l_tax").alias("column_name"), "total").unionByName(
        target.agg(F.sum(fx.money("l_extra")).alias("total")).select(F.lit("l_extra").alias("column_name"), "total")
    )
    return diff.join(sums, "column_name").select("type", "column_name", F.col("total").cast("double").alias("total"))


@query("P19_mapping_summary", """SELECT * FROM (VALUES ('o_orderkey', 'o_orderkey', 'Suggested Key', 'Suggested Key', 'Key Match'),
  ('o_custkey', '-- Ignored / Skipped --', 'Normal', 'Ignored', 'Skipped'), ('o_orderstatus', 'o_orderstatus', 'Normal', 'Normal', 'Mapped'),
  ('—', 'o_custkey', 'Normal', 'Normal', 'Target Only'), ('—', 'region_code', 'Normal', 'Suggested Key', 'Target Only')) t(source_column, target_column, source_key_type, target_key_type, status),
  (SELECT count(*) AS n FROM orders)""")
def p19(spark, sf_dir):
    """Summary (P-19) with its filter (F-8) left open, next to the row count of the mapped table."""
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    target = o.withColumn("region_code", F.lit("x"))
    summary = al.mapping_summary(spark, o.columns, target.columns, ["o_orderkey"], {"o_custkey": "__ignore__"})
    return al.filter_mapping(summary).withColumn("n", target.agg(F.count("*")).scalar())


@query("F8_mapping_filter", "SELECT 'o_orderkey' AS source_column, count(*) AS n FROM orders")
def f8(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    summary = al.mapping_summary(spark, o.columns, o.columns, ["o_orderkey"])
    return al.filter_mapping(summary, source="ORDERK", key_type="Key Match").select("source_column").withColumn("n", o.agg(F.count("*")).scalar())


CANON_VALUES = """SELECT DISTINCT x.raw FROM (SELECT CAST(amt AS VARCHAR) AS raw FROM o UNION ALL SELECT '$' || CAST(amt AS VARCHAR) || '0' FROM o
  UNION ALL SELECT d FROM o UNION ALL SELECT d || ' 00:00:00' FROM o UNION ALL SELECT ' ' || status || ' ' FROM o UNION ALL SELECT '' FROM o) x"""


def canon_values(spark, sf_dir):
    o = fx._orders(spark, sf_dir)
    amt = F.col("amt").cast("string")
    cells = F.array(
        amt, F.concat(F.lit("$"), amt, F.lit("0")), F.col("d"), F.concat("d", F.lit(" 00:00:00")),
        F.concat(F.lit(" "), "status", F.lit(" ")), F.lit(""),
    )
    return o.select(F.explode(cells).alias("raw")).distinct()


@query("S1_canonical", f"WITH {fx.SQL_ORDERS}, v AS ({CANON_VALUES}) SELECT raw, {fx.sql_canon('raw')} AS canon FROM v")
def s1(spark, sf_dir):
    return canon_values(spark, sf_dir).select("raw", vl.canonical(F.col("raw")).alias("canon"))


@query(
    "S2_display",
    f"WITH {fx.SQL_ORDERS}, v AS ({CANON_VALUES}) SELECT raw, coalesce(CASE WHEN TRY_CAST({fx.sql_bare('raw')} AS DECIMAL(38,12)) IS NULL THEN CAST(TRY_CAST(trim(raw) AS DATE) AS VARCHAR) END, raw) AS shown FROM v",
)
def s2(spark, sf_dir):
    return canon_values(spark, sf_dir).select("raw", vl.display_value(F.col("raw")).alias("shown"))


AMOUNT_TEXTS = "SELECT k, CASE k % 4 WHEN 0 THEN '(' || CAST(amt AS VARCHAR) || ')' WHEN 1 THEN 'USD ' || CAST(amt AS VARCHAR) WHEN 2 THEN '-' ELSE '-$' || CAST(amt AS VARCHAR) END AS t, amt FROM o"


@query(
    "S3_clean_amount",
    f"WITH {fx.SQL_ORDERS}, a AS ({AMOUNT_TEXTS}) SELECT k, CAST(CASE k % 4 WHEN 0 THEN -amt WHEN 1 THEN amt WHEN 2 THEN NULL ELSE -amt END AS DOUBLE) AS amount FROM a",
)
def s3(spark, sf_dir):
    o, k, amt = fx._orders(spark, sf_dir), F.col("k") % 4, F.col("amt").cast("string")
    t = F.when(k == 0, F.concat(F.lit("("), amt, F.lit(")"))).when(k == 1, F.concat(F.lit("USD "), amt)).when(k == 2, "-").otherwise(F.concat(F.lit("-$"), amt))
    return o.select("k", vl.clean_amount(t).cast("double").alias("amount"))


@query(
    "S5_day",
    f"WITH {fx.SQL_ORDERS} SELECT CASE WHEN k % 31 = 0 THEN 'Undated' ELSE d END AS day, count(*) AS n FROM o GROUP BY 1",
)
def s5(spark, sf_dir):
    """S-4 and S-5: dates in four spellings, some unreadable."""
    d = F.to_date("d")
    t = (
        F.when(F.col("k") % 31 == 0, "soon").when(F.col("k") % 4 == 0, F.date_format(d, "MM/dd/yyyy"))
        .when(F.col("k") % 4 == 1, F.date_format(d, "d MMM yyyy")).when(F.col("k") % 4 == 2, F.concat("d", F.lit("T10:20:30"))).otherwise(F.col("d"))
    )
    return fx._orders(spark, sf_dir).groupBy(vl.day_of(t).alias("day")).agg(F.count("*").alias("n"))


@query("S6_lookup_text", "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS t FROM part")
def s6(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select("p_partkey", tx.lookup_text(F.col("p_name")).alias("t"))


@query("S7_key_text", "SELECT CAST(l_orderkey AS VARCHAR) || '||' || CAST(l_linenumber AS VARCHAR) AS k, count(*) AS n FROM lineitem GROUP BY 1")
def s7(spark, sf_dir):
    key = tx.key_text([F.col("l_orderkey"), F.col("l_linenumber")])
    return fx.table(spark, sf_dir, "lineitem").groupBy(key.alias("k")).agg(F.count("*").alias("n"))


@query("S8_strip_suffix", "SELECT CAST(l_orderkey AS VARCHAR) AS stem, count(*) AS n FROM lineitem GROUP BY 1")
def s8(spark, sf_dir):
    number = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return fx.table(spark, sf_dir, "lineitem").groupBy(tx.strip_suffix(number).alias("stem")).agg(F.count("*").alias("n"))


@query("S9_strict_number", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS strict,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) ELSE 0 END AS lenient FROM orders""")
def s9(spark, sf_dir):
    """S-9 and S-10: unreadable texts are null or 0."""
    amt = fx.money("o_totalprice").cast("string")
    t = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("about "), amt)).otherwise(F.concat(F.lit("$"), amt))
    return fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", vl.strict_number(t).cast("double").alias("strict"), vl.lenient_amount(t).cast("double").alias("lenient")
    )


@query("S15_null_like", "SELECT count(*) FILTER (l_linenumber = 1) AS empty, count(*) FILTER (l_linenumber <> 1) AS filled FROM lineitem")
def s15(spark, sf_dir):
    t = F.when(F.col("l_linenumber") == 1, F.element_at(F.array(*[F.lit(x) for x in (" NaN ", "none", "<NA>", "  ")]), (F.col("l_orderkey") % 4 + 1).cast("int"))).otherwise(F.col("l_returnflag"))
    return fx.table(spark, sf_dir, "lineitem").agg(F.count_if(tx.null_like(t)).alias("empty"), F.count_if(~tx.null_like(t)).alias("filled"))


@query("S16_token_overlap", """WITH w AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part)
  SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS overlap FROM w""")
def s16(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select(
        "p_partkey", F.round(tx.token_overlap(F.lower("p_name"), F.lower("p_type")), 6).alias("overlap")
    )


@query("S17_char_grams", """WITH w AS (SELECT DISTINCT s_suppkey, unnest(string_split(lower(s_name), ' ')) AS w FROM supplier),
  p AS (SELECT s_suppkey, ' ' || w || ' ' AS w FROM w WHERE w <> ''),
  g AS (SELECT s_suppkey, substr(w, CAST(i AS BIGINT), CAST(n AS BIGINT)) AS gram FROM p, range(2, 5) t(n), range(1, 200) r(i) WHERE i <= length(w) - n + 1)
  SELECT gram, count(*) AS n FROM g GROUP BY 1""")
def s17(spark, sf_dir):
    grams = fx.table(spark, sf_dir, "supplier").select(F.explode(tx.char_grams(F.col("s_name"))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


@query("S19_row_text", "SELECT 'c_custkey: ' || c_custkey || '; c_name: ' || c_name || '; c_mktsegment: ' || c_mktsegment AS t FROM customer")
def s19(spark, sf_dir):
    return fx.table(spark, sf_dir, "customer").select(tx.row_text(["c_custkey", "c_name", "c_mktsegment"]).alias("t"))


CHUNK_SQL = """t AS (SELECT doc_id, 'doc_id | lang | text' || chr(10) || 'doc_id: ' || doc_id || '; lang: ' || coalesce(lang, '') || '; text: ' || coalesce(text, '') AS t FROM documents)"""


@query(
    "SNK5_chunks",
    f"WITH {CHUNK_SQL} SELECT doc_id, i AS chunk_index, length(substr(t, i * 800 + 1, 800)) AS size, md5(substr(t, i * 800 + 1, 800)) AS hash FROM t, range(0, 1000000) r(i) WHERE i * 800 < length(t)"
    .replace("range(0, 1000000) r(i) WHERE i * 800 < length(t)", "LATERAL (SELECT unnest(range(0, CAST(ceil(length(t) / 800.0) AS BIGINT))) AS i)"),
)
def snk5(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "lang", "text", F.col("doc_id").alias("_rid"))
    return chunk_rows(docs).select(
        F.col("_rid").alias("doc_id"), F.col("chunk_index").cast("long").alias("chunk_index"),
        F.length("chunk").cast("long").alias("size"), F.md5("chunk").alias("hash"),
    )


@query("SNK6_chunk_records", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, md5(text) AS hash FROM documents")
def snk6(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "lang", "text", F.col("doc_id").alias("_rid"))
    back = chunk_records(chunk_rows(docs), ["doc_id", "lang", "text"])
    return back.select(F.col("record")["doc_id"].alias("doc_id"), F.col("record")["lang"].alias("lang"), F.md5(F.col("record")["text"]).alias("hash"))


@query("SRC4_named_target", "SELECT c_custkey, c_name FROM customer")
def src4(spark, sf_dir):
    targets = rd.Targets({"customers": f"{sf_dir}/customer.parquet", "suppliers": f"{sf_dir}/supplier.parquet"}, default="customers")
    assert targets.resolve(" Suppliers ")[0] == "suppliers"
    return targets.read(spark, "unknown project").select("c_custkey", "c_name")


def stage_two_batches(spark, sf_dir):
    path = scratch(spark, "staging")
    c = fx.table(spark, sf_dir, "customer")
    at = lambda t: F.lit(t).cast("timestamp")
    ct.stage_rows(c.select("c_custkey"), path, "p", "customer", "c_custkey", "b1", at("2000-01-01 00:00:00"))
    sparse = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("c_name"), "c_mktsegment")
    ct.stage_rows(sparse, path, "p", "customer", "c_custkey", "b2", at("2000-01-02 00:00:00"))
    return ct.staged(spark, path)


@query("SRC7_latest_batch", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS c_name, c_mktsegment FROM customer")
def src7(spark, sf_dir):
    """SNK-1 staging, SRC-7 latest batch, SRC-5 records to columns."""
    return rd.records_to_columns(rd.latest_batch(stage_two_batches(spark, sf_dir)), ["c_custkey", "c_name", "c_mktsegment"])


@query(
    "SRC6_column_union",
    "SELECT k AS column_name, min(event_id) AS first_row, count(*) AS n FROM (SELECT event_id, unnest(json_keys(props)) AS k FROM events) GROUP BY 1",
)
def src6(spark, sf_dir):
    """Keys of the events' JSON records over all rows, with how often they occur (SRC-5)."""
    e = fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("_rid"), F.col("props").alias("row_data"))
    found = rd.record_columns(e)
    names = rd.column_names(found)
    wide = rd.records_to_columns(e, names)
    used = wide.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "column_name", "n")
    return found.select("column_name", "first_row").join(used, "column_name")
