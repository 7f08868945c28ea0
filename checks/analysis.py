"""Profiles, matching, reports, days, insights, history, paging, row pairs."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from checks import fixtures as fx
from checks.comparisons import KEYS, b1_comparison, b2_ledger, b3, or_none
from checks.registry import query
from checks.scans import scratch
from tablematch.functions import values as vl
from tablematch.operators import catalogue as cg
from tablematch.operators import days as dy
from tablematch.operators import history as hs
from tablematch.operators import insights as ins
from tablematch.operators import keys as ky
from tablematch.operators import ledger as lg
from tablematch.operators import profile as pf
from tablematch.operators import report as rp
from tablematch.operators import rowpairs as rw
from tablematch.operators import schema_match as sm
from tablematch.operators import search as se
from tablematch.operators.cells import as_records
from tablematch.operators.clean import normalize
from tablematch.operators.lines import compare_lines
from tablematch.operators.master import compare_master
from tablematch.plans.assign import match_texts
from tablematch.plans.similarity import text_similarities
from tablematch.plans.skew import durable
from tablematch.vocabulary import default_vocabulary

# ---- profiles and keys --------------------------------------------------------------------------------------------

ORDER_COLS = {"o_orderkey": 1, "o_custkey": 1, "o_orderstatus": 0, "o_totalprice": 1, "o_orderpriority": 0}


def _profile_sql(table: str, cols: dict[str, int]) -> str:
    def one(c, numeric):
        num = f"CAST({c} AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)"
        return (
            f"SELECT '{c}' AS column_name, count(*) AS total_rows, count({c}) AS non_null_count, count(DISTINCT {c}) AS unique_count, "
            f"round(count(DISTINCT {c}) / count({c}), 4) AS uniqueness_ratio, count({c}) - count(DISTINCT {c}) AS duplicate_count, "
            f"min({num}) AS min_val, max({num}) AS max_val, round(avg({num}), 2) AS mean_val, quantile_cont({num}, 0.5) AS median_val, "
            f"round(stddev_samp({num}), 2) AS std_val, " + ("0.0" if numeric else f"round(avg(length({c})), 2)") + f" AS avg_str_length FROM {table}"
        )

    return " UNION ALL ".join(one(c, n) for c, n in cols.items())


@query("A3_profile", _profile_sql("orders", ORDER_COLS))
def a3(spark, sf_dir):
    p = pf.profile(fx.table(spark, sf_dir, "orders").select(*ORDER_COLS, F.col("o_orderkey").alias("_rid")))
    return p.select(
        "column_name", "total_rows", "non_null_count", "unique_count", "uniqueness_ratio", "duplicate_count", "min_val", "max_val",
        F.round("mean_val", 2).alias("mean_val"), "median_val", F.round("std_val", 2).alias("std_val"), "avg_str_length",
    )


@query("A4_logical_types", """SELECT * FROM (VALUES ('o_orderkey', 'Identifier'), ('o_custkey', 'Integer'), ('o_orderstatus', 'Categorical'),
  ('o_totalprice', 'Decimal'), ('o_orderpriority', 'Categorical'), ('day', 'Date'), ('at', 'Datetime'), ('mail', 'Email'), ('phone', 'Phone'),
  ('flag', 'Boolean')) t(column_name, inferred_logical_type), (SELECT count(*) AS total_rows FROM orders)""")
def a4(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    t = o.select(
        *ORDER_COLS, F.col("o_orderdate").cast("date").cast("string").alias("day"), F.col("o_orderdate").cast("string").alias("at"),
        F.concat(F.lit("u"), key, F.lit("@example.org")).alias("mail"), F.concat(F.lit("+1 555-"), F.lpad(key, 8, "0")).alias("phone"),
        F.when(F.col("o_orderkey") % 2 == 0, "yes").otherwise("no").alias("flag"), F.col("o_orderkey").alias("_rid"),
    )
    return pf.profile(t).select("column_name", "inferred_logical_type", "total_rows")


@query("A5_keys", """WITH c AS (SELECT 'o_orderkey' AS column_name, count(DISTINCT o_orderkey) / count(*) AS u, 0.2 AS h FROM orders
  UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey) / count(*), 0.2 FROM orders
  UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) / count(*), 0 FROM orders)
  SELECT column_name, round(round(u, 4) * 0.55 + 0.25 + h, 4) AS score FROM c""")
def a5(spark, sf_dir):
    t = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderkey").alias("_rid"))
    return pf.key_candidates(pf.profile(t)).select("column_name", "score")


@query("A6_guess_key", "SELECT o_orderkey AS key_value FROM orders")
def a6(spark, sf_dir):
    """No known name: the most unique common column is taken."""
    o = fx.table(spark, sf_dir, "orders").select("o_orderstatus", "o_custkey", "o_orderkey")
    return o.select(F.col(pf.guess_key_columns(o, o)[0]).alias("key_value"))


@query("A7_business_key", "SELECT l_orderkey AS key_value, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderkey, 1 FROM orders")
def a7(spark, sf_dir):
    """No candidate is unique in lineitem: its first is taken; in orders the second candidate is."""
    li = fx.table(spark, sf_dir, "lineitem").select("l_quantity", "l_orderkey", "l_partkey")
    o = fx.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    one = li.groupBy(F.col(pf.detect_business_key(li)).alias("key_value")).agg(F.count("*").alias("n"))
    return one.unionByName(o.select(F.col(pf.detect_business_key(o)).alias("key_value"), F.lit(1).cast("long").alias("n")))


@query("A8_duplicate_share", """WITH k AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT round(sum(n) FILTER (n > 1) / sum(n), 6) AS share, 'transactional' AS data_type, 'master' AS other FROM k""")
def a8(spark, sf_dir):
    li, c = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_tax"), fx.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return pf.duplicate_share(li, ["l_orderkey"]).select(
        F.round("share", 6).alias("share"), F.lit(pf.resolve_data_type("auto", li, li, ["l_orderkey"])).alias("data_type"),
        F.lit(pf.resolve_data_type("auto", c, c, ["c_custkey"])).alias("other"),
    )


@query("A9_file_type_facts", """WITH t AS (SELECT CAST(o_custkey AS VARCHAR) AS customer, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders)
  SELECT 'customer' AS column_name, count(*) AS filled, count(DISTINCT customer) AS distinct_values, 0 AS dates, count(*) AS numbers, 'transactional' AS type FROM t
  UNION ALL SELECT 'amount', count(*), count(DISTINCT amount), 0, count(*), 'transactional' FROM t
  UNION ALL SELECT 'day', count(*), count(DISTINCT day), count(*), 0, 'transactional' FROM t""")
def a9(spark, sf_dir):
    t = fx.b1_source(spark, sf_dir).select(F.col("cust").alias("customer"), "amount", F.col("d").alias("day"))
    kind = pf.detect_file_type(t, default_vocabulary())["type"]
    return pf.file_type_facts(t).select("column_name", "filled", "distinct_values", "dates", "numbers", F.lit(kind).alias("type"))


@query("A10_date_column", "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS n FROM orders GROUP BY 1")
def a10(spark, sf_dir):
    """No name says 'date': the column whose values parse is taken."""
    t = fx.b1_source(spark, sf_dir).select("cust", "status", F.col("d").alias("when_made"))
    name = pf.detect_date_column(t, t)
    return t.groupBy(vl.day_of(F.col(name)).alias("day")).agg(F.count("*").alias("n"))


@query("A14_column_sum", "SELECT count(*) AS n, CAST(sum(CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS total FROM orders")
def a14(spark, sf_dir):
    t = F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.concat(F.lit("$ "), fx.money("o_totalprice").cast("string")))
    amounts = fx.table(spark, sf_dir, "orders").select(vl.lenient_amount(t).alias("a"))
    return amounts.agg(F.count("*").alias("n"), F.sum("a").cast("double").alias("total"))


# ---- column matching ----------------------------------------------------------------------------------------------


def renamed_orders(spark, sf_dir):
    o = fx.b1_source(spark, sf_dir)
    target = fx.b1_target(spark, sf_dir)
    return o.toDF("orderNumber", "customerCode", "statusFlag", "totalAmount", "orderDate", "_rid"), target.toDF(
        "order_no", "customer", "status", "amount_total", "date_of_order", "_rid"
    )


KEYED = {
    "orders": "o_orderkey o_custkey o_orderstatus o_orderpriority", "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity",
    "conversations": "conv_id turn role text", "events": "user_id event_type ts value", "supplier": "s_name s_nationkey s_acctbal",
}


def _key_sets(most: int):
    for t, names in KEYED.items():
        columns = names.split()
        for k in range(1, most + 1):
            for s in combinations(columns, k):
                yield t, s


KEYS_SQL = "WITH u AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS t, {list(s)} AS key_columns, count(*) = count(DISTINCT ({', '.join(s)},)) AS hit FROM {t}" if len(s) == 1 else
    f"SELECT '{t}' AS t, {list(s)} AS key_columns, count(*) = count(DISTINCT ({', '.join(s)})) AS hit FROM {t}" for t, s in _key_sets(3)
) + """) SELECT t AS table_name, array_to_string(key_columns, ',') AS key_columns, len(key_columns) AS size FROM u
WHERE hit AND NOT EXISTS (SELECT 1 FROM u v WHERE v.t = u.t AND v.hit AND len(v.key_columns) < len(u.key_columns) AND list_has_all(u.key_columns, v.key_columns))"""


@query("A5_composite_keys", f"SELECT * REPLACE (CAST(size AS INT) AS size) FROM ({KEYS_SQL})")
def a5_composite(spark, sf_dir):
    """All least keys of up to three columns of five tables."""
    found = [ky.composite_keys(fx.table(spark, sf_dir, t), names.split(), 3).withColumn("table_name", F.lit(t)) for t, names in KEYED.items()]
    return reduce(DataFrame.union, found).select("table_name", F.array_join("key_columns", ",").alias("key_columns"), "size")


#: Ratios of the names of `renamed_orders` (S-12): twice the characters in matching blocks over all characters, per row of the source.
NAME_RATIOS = [(14 / 20, 6 / 20, 2 / 18, 4 / 24, 10 / 25), (10 / 21, 16 / 21, 4 / 19, 6 / 25, 8 / 26), (2 / 19, 4 / 19, 12 / 17, 6 / 23, 8 / 24),
               (6 / 20, 6 / 20, 6 / 18, 12 / 24, 8 / 25), (12 / 18, 6 / 18, 4 / 16, 6 / 22, 10 / 23)]
J11_SQL = f"""WITH {fx.SQL_ORDERS}, {fx.SQL_B1_SOURCE}, {fx.sql_b1_target()},
names AS (SELECT * FROM (VALUES ('s', 0, 'orderNumber', 'order number', 'Identifier'), ('s', 1, 'customerCode', 'customer code', 'String'), ('s', 2, 'statusFlag', 'status flag', 'Categorical'),
  ('s', 3, 'totalAmount', 'total amount', 'Phone'), ('s', 4, 'orderDate', 'order date', 'Date'), ('t', 0, 'order_no', 'order no', 'Identifier'), ('t', 1, 'customer', 'customer', 'String'),
  ('t', 2, 'status', 'status', 'Categorical'), ('t', 3, 'amount_total', 'amount total', 'Phone'), ('t', 4, 'date_of_order', 'date of order', 'Date')) n(side, pos, name, words, kind)),
cells AS (SELECT 's' AS side, unnest([order_no, cust, status, amount, d]) AS v, unnest([0, 1, 2, 3, 4]) AS pos FROM b1s
  UNION ALL SELECT 't', unnest([order_no, cust, status, amount, d]), unnest([0, 1, 2, 3, 4]) FROM b1t),
stats AS (SELECT side, pos, count(*) AS n, round(count(DISTINCT v) / count(*), 4) AS uniq, round(avg(length(v)), 2) AS len, count(DISTINCT trim(v)) AS d FROM cells GROUP BY ALL),
c AS (SELECT * FROM names JOIN stats USING (side, pos)),
ratios AS (SELECT s.i AS sp, t.j AS tp, ({list(map(list, NAME_RATIOS))})[s.i + 1][t.j + 1] AS ratio FROM range(5) s(i), range(5) t(j)),
shared AS (SELECT a.pos AS sp, b.pos AS tp, count(DISTINCT trim(a.v)) AS n FROM cells a JOIN cells b ON trim(a.v) = trim(b.v) AND a.side = 's' AND b.side = 't' GROUP BY ALL),
p AS (SELECT 'pair' AS pair_id, s.pos AS source_pos, t.pos AS target_pos, s.name AS source_column, t.name AS target_column,
  round(CASE WHEN contains(s.words, t.words) OR contains(t.words, s.words) THEN greatest(ratio, 0.85) ELSE ratio END, 4) AS header_similarity,
  CASE WHEN s.kind = t.kind THEN 1.0 ELSE 0.4 END AS datatype_compatibility, round(coalesce(x.n, 0) / (s.d + t.d - coalesce(x.n, 0)), 4) AS value_overlap,
  CASE WHEN s.kind = t.kind AND s.kind IN ('Email', 'Phone', 'Identifier', 'Date', 'Datetime') THEN 1.0 ELSE 0.5 END AS pattern_similarity,
  round(greatest(0, 1 - abs(s.len - t.len) / 50), 4) AS profile_similarity,
  round(len(list_intersect(string_split(s.words, ' '), string_split(t.words, ' '))) / len(list_distinct(list_concat(string_split(s.words, ' '), string_split(t.words, ' ')))), 4) AS semantic_similarity,
  round(greatest(0, 1 - abs(s.uniq - t.uniq)), 4) AS uniqueness_compatibility, 1.0 AS null_compatibility
  FROM c s JOIN c t ON s.side = 's' AND t.side = 't' JOIN ratios ON sp = s.pos AND tp = t.pos LEFT JOIN shared x ON x.sp = s.pos AND x.tp = t.pos),
q AS (SELECT *, round(header_similarity * 0.25 + datatype_compatibility * 0.15 + value_overlap * 0.2 + pattern_similarity * 0.1 + profile_similarity * 0.1 + semantic_similarity * 0.1
  + uniqueness_compatibility * 0.05 + null_compatibility * 0.05, 4) AS confidence FROM p)
SELECT *, CASE WHEN confidence >= 0.85 THEN 'VERY HIGH' WHEN confidence >= 0.7 THEN 'HIGH' WHEN confidence >= 0.5 THEN 'NEEDS REVIEW' ELSE 'LOW' END AS category FROM q"""
_SIGNALS = "header_similarity datatype_compatibility value_overlap pattern_similarity profile_similarity semantic_similarity uniqueness_compatibility null_compatibility confidence"


@query("J11_column_signals", f"SELECT * REPLACE (CAST(source_pos AS INT) AS source_pos, CAST(target_pos AS INT) AS target_pos) FROM ({J11_SQL})", double=_SIGNALS)
def j11(spark, sf_dir):
    return sm.column_signals(*renamed_orders(spark, sf_dir))


@query("J11_value_overlap", f"""WITH {fx.SQL_ORDERS}, {fx.SQL_B1_SOURCE}, {fx.sql_b1_target()},
  s AS (SELECT * FROM b1s), t AS (SELECT * FROM b1t),
  sv AS (SELECT DISTINCT 'order_no' AS c, order_no AS v FROM s UNION SELECT 'cust', cust FROM s UNION SELECT 'd', d FROM s UNION SELECT 'status', status FROM s UNION SELECT 'amount', amount FROM s),
  tv AS (SELECT DISTINCT 'order_no' AS c, order_no AS v FROM t UNION SELECT 'cust', cust FROM t UNION SELECT 'd', d FROM t UNION SELECT 'status', status FROM t UNION SELECT 'amount', amount FROM t)
  SELECT x.c AS source_column, y.c AS target_column, round(count(*) / ((SELECT count(*) FROM sv WHERE c = x.c) + (SELECT count(*) FROM tv WHERE c = y.c) - count(*)), 6) AS overlap
  FROM sv x JOIN tv y ON x.v = y.v GROUP BY x.c, y.c""")
def j11_overlap(spark, sf_dir):
    """U-4: Jaccard of all values."""
    o = sm.value_overlap(fx.b1_source(spark, sf_dir), fx.b1_target(spark, sf_dir))
    return o.select("source_column", "target_column", F.round("overlap", 6).alias("overlap"))


#: Columns of whole numbers and texts of the given tables.
CATALOGUE = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey", "part": "p_partkey p_name p_brand p_type p_size", "orders": "o_orderkey o_custkey o_orderstatus o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_returnflag l_linestatus", "events": "event_id user_id event_type",
    "documents": "doc_id text lang source n_chars", "labels": "doc_id quality toxic", "benchmark": "item_id text", "conversations": "conv_id turn role text",
}
CATALOGUE_SQL = "WITH RECURSIVE c AS (" + " UNION ALL ".join(
    f"SELECT DISTINCT '{t}' AS t, {i} AS i, '{c}' AS c, trim(CAST({c} AS VARCHAR)) AS v FROM {t} WHERE {c} IS NOT NULL"
    for t, names in CATALOGUE.items() for i, c in enumerate(names.split())
) + """), n AS (SELECT t, i, count(*) AS n FROM c GROUP BY ALL),
x AS (SELECT a.t AS ta, a.i AS ia, a.c AS ca, b.t AS tb, b.i AS ib, b.c AS cb, count(*) AS shared FROM c a JOIN c b ON a.v = b.v AND a.t < b.t GROUP BY ALL),
y AS MATERIALIZED (SELECT x.*, shared / (p.n + q.n - shared) AS overlap FROM x JOIN n p ON p.t = ta AND p.i = ia JOIN n q ON q.t = tb AND q.i = ib WHERE shared / (p.n + q.n - shared) >= 0.1)
"""


def catalogue(spark, sf_dir):
    return {t: fx.table(spark, sf_dir, t).select(*names.split()) for t, names in CATALOGUE.items()}


@query("U4_catalogue_overlaps", CATALOGUE_SQL + "SELECT ta AS table_a, ca AS column_a, tb AS table_b, cb AS column_b, shared, round(overlap, 6) AS overlap FROM y")
def u4_catalogue(spark, sf_dir):
    """All column pairs of twelve tables that share a tenth of their values: by sketches, then exactly."""
    found = cg.catalogue_overlaps(catalogue(spark, sf_dir), least=0.1)
    return found.select("table_a", "column_a", "table_b", "column_b", "shared", F.round("overlap", 6).alias("overlap"))


@query("J12_column_assignment", CATALOGUE_SQL + """, e AS (SELECT ta, tb, ia, ib, CAST(round(overlap * 10000) AS BIGINT) AS s FROM y),
d AS (
  SELECT DISTINCT ta, tb, 0 AS k, 0 AS mask, 0::BIGINT AS total FROM e
  UNION ALL
  SELECT ta, tb, k, mask, max(total) FROM (
    SELECT ta, tb, k + 1 AS k, mask, total FROM d WHERE k < 8
    UNION ALL SELECT d.ta, d.tb, d.k + 1, d.mask | (1 << e.ib), d.total + e.s FROM d JOIN e ON e.ta = d.ta AND e.tb = d.tb AND e.ia = d.k AND (d.mask >> e.ib) & 1 = 0 WHERE k < 8
  ) GROUP BY ALL HAVING true
) SELECT ta AS table_a, tb AS table_b, max(total) AS total FROM d GROUP BY ALL""", long="total")
def j12(spark, sf_dir):
    """The best one-to-one choice of columns for every two tables; the SQL tries all sets of columns."""
    chosen = cg.assign_by_overlap(cg.catalogue_overlaps(catalogue(spark, sf_dir), least=0.1))
    return chosen.groupBy("table_a", "table_b").agg(F.sum("score").alias("total"))


# ---- similar keys -------------------------------------------------------------------------------------------------


def b4(spark, sf_dir):
    """B4: suppliers of whom every fifth is renamed on the target side."""
    s = fx.table(spark, sf_dir, "supplier").withColumn("h", F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 10))
    cells = [fx.money("s_acctbal").cast("string").alias("balance"), F.col("s_nationkey").cast("string").alias("nation"), F.col("s_suppkey").alias("_rid")]
    new = F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("Supp "), "h")).otherwise(F.concat(F.lit("Supplier "), "h"))
    return s.select(F.concat(F.lit("Supplier "), "h").alias("name"), *cells), s.select(new.alias("name"), *cells)


def b4_leftovers(spark, sf_dir):
    s, t = b4(spark, sf_dir)
    left = s.join(t.select("name"), "name", "left_anti")
    right = t.join(s.select("name"), "name", "left_anti")
    pick = lambda df: df.select(F.col("_rid").alias("rid"), F.col("name").alias("text"))
    return pick(left), pick(right)


B4 = """WITH s AS (SELECT s_suppkey AS rid, 'Supplier ' || substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 10) AS name FROM supplier),
t AS (SELECT s_suppkey AS rid, CASE WHEN s_suppkey % 5 = 0 THEN 'Supp ' ELSE 'Supplier ' END || substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 10) AS name FROM supplier),
u AS (SELECT 'l' AS side, rid, name FROM s WHERE name NOT IN (SELECT name FROM t) UNION ALL SELECT 'r', rid, name FROM t WHERE name NOT IN (SELECT name FROM s)),
w AS (SELECT side, rid, ' ' || unnest(string_split(lower(name), ' ')) || ' ' AS w FROM u),
g AS (SELECT side, rid, substr(w, CAST(i AS BIGINT), CAST(n AS BIGINT)) AS gram, count(*) AS tf FROM w, range(2, 5) a(n), range(1, 64) b(i) WHERE i <= length(w) - n + 1 GROUP BY ALL),
d AS (SELECT gram, count(*) AS df FROM g GROUP BY 1),
v AS (SELECT side, rid, g.gram, tf * (ln((1 + (SELECT count(*) FROM u)) / (1 + df)) + 1) AS x FROM g JOIN d ON g.gram = d.gram),
n AS (SELECT side, rid, sqrt(sum(x * x)) AS norm FROM v GROUP BY ALL),
c AS (SELECT a.rid AS l, b.rid AS r, round(sum(a.x * b.x) / max(p.norm * q.norm), 6) AS score
      FROM v a JOIN v b ON a.gram = b.gram AND a.side = 'l' AND b.side = 'r' JOIN n p ON p.side = 'l' AND p.rid = a.rid JOIN n q ON q.side = 'r' AND q.rid = b.rid
      GROUP BY ALL HAVING sum(a.x * b.x) / max(p.norm * q.norm) >= 0.6)
"""


@query("J9_scores", B4 + "SELECT l, r, score FROM c")
def j9(spark, sf_dir):
    pairs = text_similarities(*b4_leftovers(spark, sf_dir))
    return pairs.select(F.col("l_id").alias("l"), F.col("r_id").alias("r"), F.round("score", 6).alias("score"))


@query("J10_pairs", B4 + "SELECT l, r, score FROM c QUALIFY row_number() OVER (PARTITION BY l ORDER BY score DESC, ('0x' || substr(md5(l || ':' || r), 1, 15))::BIGINT DESC, r DESC) = 1 AND row_number() OVER (PARTITION BY r ORDER BY score DESC, ('0x' || substr(md5(l || ':' || r), 1, 15))::BIGINT DESC, l DESC) = 1")
def j10(spark, sf_dir):
    pairs = match_texts(*b4_leftovers(spark, sf_dir))
    return pairs.select(F.col("left_rid").alias("l"), F.col("right_rid").alias("r"), F.round("score", 6).alias("score"))


def b4_comparison(spark, sf_dir):
    s, t = b4(spark, sf_dir)
    return compare_master(normalize(s), normalize(t), ["name"])


@query("C2_renamed", B4 + """SELECT s.name AS key_before, t.name AS key_after, 'Renamed' AS status, round(score, 4) AS confidence FROM c JOIN s ON c.l = s.rid JOIN t ON c.r = t.rid
  UNION ALL SELECT s.name, t.name, 'Matched', NULL FROM s JOIN t ON s.name = t.name""")
def c2_renamed(spark, sf_dir):
    rows = b4_comparison(spark, sf_dir).rows
    return rows.select(F.col("src.name").alias("key_before"), F.col("tgt.name").alias("key_after"), "status", "confidence")


@query("R4_renamed_sheet", B4 + """SELECT 'Renamed' AS "Status", round(score, 4) AS "Match Confidence", s.name AS "Key Before (name)", t.name AS "Key After (name)", '(key only)' AS "Changed Columns"
  FROM c JOIN s ON c.l = s.rid JOIN t ON c.r = t.rid""")
def r4(spark, sf_dir):
    return rp.renamed_sheet(b4_comparison(spark, sf_dir)).drop("balance", "nation")


# ---- comparison results -------------------------------------------------------------------------------------------


@query("C7_record_maps", fx.B1 + "SELECT order_no, status, coalesce(t_amount, '') AS amount FROM rows LEFT JOIN pairs USING (order_no) WHERE status NOT IN ('Added', 'Deleted') UNION ALL SELECT order_no, status, '' FROM rows WHERE status = 'Deleted' UNION ALL SELECT b.order_no, 'Added', b.amount FROM b1t b WHERE b.order_no NOT IN (SELECT order_no FROM b1s)")
def c7(spark, sf_dir):
    """U-1: all records with generic maps; a missing side is an empty map."""
    c = b1_comparison(spark, sf_dir)
    return as_records(c.rows, c.layout).select(
        F.col("key")["order_no"].alias("order_no"), "status", F.coalesce(F.col("target_row")["amount"], F.lit("")).alias("amount")
    )


BUCKETS = fx.B1 + """, b AS (SELECT count(*) FILTER (status = 'Deleted') AS missing_in_target, count(*) FILTER (status = 'Added') AS missing_in_source,
  count(*) FILTER (nv > 0) AS mismatches, count(*) FILTER (nf > 0) AS format_inconsistencies, 0 AS fuzzy_matches,
  count(*) FILTER (status = 'Matched') AS matched, count(*) AS full_comparison, (SELECT count(*) FROM dups WHERE n > 1) AS duplicates_source,
  (SELECT count(*) FROM dupt WHERE n > 1) AS duplicates_target, (SELECT count(*) FROM b1s) AS source_record_count,
  (SELECT count(*) FROM b1t) AS target_record_count FROM rows)
"""


@query("A11_bucket_counts", BUCKETS + "SELECT * FROM b", long="fuzzy_matches")
def a11(spark, sf_dir):
    return ins.bucket_counts(b1_comparison(spark, sf_dir))


@query("A21_churn", BUCKETS + """, t AS (SELECT missing_in_source + missing_in_target + mismatches + duplicates_source + duplicates_target AS touched, greatest(source_record_count, target_record_count) AS n FROM b)
  SELECT touched, round(100.0 * touched / n, 1) AS churn_percent, CASE WHEN 100.0 * touched / n < 5 THEN 'very few changes' WHEN 100.0 * touched / n < 15 THEN 'few changes'
  WHEN 100.0 * touched / n < 35 THEN 'some changes' ELSE 'many changes' END AS churn_label FROM t""")
def a21(spark, sf_dir):
    return ins.churn(ins.bucket_counts(b1_comparison(spark, sf_dir))).select("touched", "churn_percent", "churn_label")


@query("A16_column_changes", fx.B1 + "SELECT column_name, count(*) AS n FROM cells GROUP BY 1")
def a16(spark, sf_dir):
    return ins.column_changes(b1_comparison(spark, sf_dir).rows)


@query("L4_top_columns", fx.B3 + "SELECT column_name, count(*) AS n FROM cells GROUP BY 1 ORDER BY n DESC, column_name LIMIT 3")
def l4(spark, sf_dir):
    return ins.top_columns(compare_lines(*b3(spark, sf_dir), KEYS).rows, 3)


@query("A17_trends", fx.B1 + """, d AS (SELECT column_name, TRY_CAST(ltrim(replace(target_value, ',', ''), '$') AS DECIMAL(38,6)) - TRY_CAST(ltrim(replace(source_value, ',', ''), '$') AS DECIMAL(38,6)) AS delta FROM cells WHERE kind = 'value')
  SELECT column_name, count(*) AS n, CASE WHEN min(delta) > 0 THEN 'increased' WHEN max(delta) < 0 THEN 'decreased' ELSE 'moved in both directions' END AS direction, round(CAST(avg(delta) AS DOUBLE), 2) AS avg_change FROM d WHERE delta IS NOT NULL GROUP BY 1""")
def a17(spark, sf_dir):
    return ins.numeric_trends(b1_comparison(spark, sf_dir).rows)


@query("A18_change_shapes", fx.B1 + "SELECT column_name, kind, count(*) AS n, CASE kind WHEN 'value' THEN 'increased' ELSE 'mostly increased' END AS shape FROM cells GROUP BY ALL")
def a18(spark, sf_dir):
    return ins.change_shapes(ins.cell_changes(b1_comparison(spark, sf_dir).rows), ["column_name", "kind"])


@query("A19_clusters")
def a19(spark, sf_dir):
    return ins.clusters(durable(compare_lines(*b3(spark, sf_dir), KEYS).rows))


# ---- days ---------------------------------------------------------------------------------------------------------


def b8(spark, sf_dir):
    """B8: B1 with a blank date for every 31st order."""
    blank = lambda df: normalize(df.withColumn("d", F.when(F.floor(F.col("_rid") / 10) % 31 == 0, "").otherwise(F.col("d"))))
    return blank(fx.b1_source(spark, sf_dir)), blank(fx.b1_target(spark, sf_dir))


def b8_comparison(spark, sf_dir):
    return compare_master(*b8(spark, sf_dir), KEYS, date="d", similar=False)


_DAY = "CASE WHEN d = '' THEN 'Undated' ELSE d END"
B8 = f"""WITH {fx.SQL_ORDERS}, {fx.SQL_B1_SOURCE.replace('b1s AS', 'x1 AS')}, {fx.sql_b1_target('x2')},
b1s AS (SELECT order_no, cust, status, amount, CASE WHEN (rid // 10) % 31 = 0 THEN '' ELSE d END AS d, rid FROM x1),
b1t AS (SELECT order_no, cust, status, amount, CASE WHEN (rid // 10) % 31 = 0 THEN '' ELSE d END AS d, rid FROM x2),{fx.sql_master()},
ev AS (SELECT {_DAY} AS day, 'source_records' AS m FROM b1s UNION ALL SELECT {_DAY}, 'target_records' FROM b1t
  UNION ALL SELECT {_DAY}, 'missing_in_target' FROM rows WHERE status = 'Deleted' UNION ALL SELECT {_DAY}, 'missing_in_source' FROM rows WHERE status = 'Added'
  UNION ALL SELECT {_DAY}, 'duplicates_source' FROM dups WHERE n > 1 UNION ALL SELECT {_DAY}, 'duplicates_target' FROM dupt WHERE n > 1
  UNION ALL SELECT {_DAY}, 'mismatches' FROM rows WHERE nv > 0 UNION ALL SELECT {_DAY}, 'format_inconsistencies' FROM rows WHERE nf > 0),
days AS (SELECT day, {', '.join(f"count(*) FILTER (m = '{m}') AS {m}" for m in dy.METRICS)} FROM ev WHERE day = 'Undated' OR day <= '{fx.AS_OF}' GROUP BY 1)
"""


@query("A15_day_summary", B8 + "SELECT * FROM days")
def a15(spark, sf_dir):
    """F-7 included: days after `as_of` are dropped."""
    return dy.day_summary(b8_comparison(spark, sf_dir), fx.AS_OF)


_TOTAL = " + ".join(dy.ISSUES)


@query("A20_timeline", B8 + f"""SELECT day, missing_in_source AS added, missing_in_target AS deleted, duplicates_source + duplicates_target AS duplicates,
  mismatches AS value_changes, format_inconsistencies AS format_issues, {_TOTAL} AS total FROM days WHERE day <> 'Undated'""")
def a20(spark, sf_dir):
    return dy.timeline(dy.day_summary(b8_comparison(spark, sf_dir), fx.AS_OF))


@query("A20_busiest_day", B8 + f"SELECT (SELECT day FROM days WHERE day <> 'Undated' ORDER BY {_TOTAL} DESC, day LIMIT 1) AS busiest_day, true AS has_undated")
def a20_busiest(spark, sf_dir):
    return dy.busiest_day(dy.day_summary(b8_comparison(spark, sf_dir), fx.AS_OF))


@query("A22_narrative", fx.B1.replace("WITH o AS", "WITH o AS", 1) + """, b AS (SELECT count(*) FILTER (status = 'Deleted') AS de, count(*) FILTER (status = 'Added') AS ad, count(*) FILTER (nv > 0) AS up, count(*) FILTER (nf > 0) AS fo,
  (SELECT count(*) FROM dups WHERE n > 1) AS ds, (SELECT count(*) FROM dupt WHERE n > 1) AS dt, (SELECT count(*) FROM b1s) AS ns, (SELECT count(*) FROM b1t) AS nt FROM rows),
  p AS (SELECT *, round(100.0 * (de + ad + up + ds + dt) / greatest(ns, nt), 1) AS pct FROM b), c AS (SELECT count(*) AS n FROM cells),
  ev AS (SELECT d AS day FROM rows WHERE status IN ('Added', 'Deleted') UNION ALL SELECT d FROM rows WHERE nv > 0 UNION ALL SELECT d FROM rows WHERE nf > 0 UNION ALL SELECT d FROM dups WHERE n > 1 UNION ALL SELECT d FROM dupt WHERE n > 1),
  busy AS (SELECT day FROM ev WHERE day <= '2100-01-01' GROUP BY 1 ORDER BY count(*) DESC, day LIMIT 1)
  SELECT 0 AS pos, 'Source: ' || ns || ' rows, Target: ' || nt || ' rows, paired by order_no. ' || CAST(pct AS VARCHAR) || '% of the rows differ (' ||
    CASE WHEN pct < 5 THEN 'very few changes' WHEN pct < 15 THEN 'few changes' WHEN pct < 35 THEN 'some changes' ELSE 'many changes' END || ').' AS sentence FROM p
  UNION ALL SELECT 1, 'Records: ' || ad || ' only in Target, ' || de || ' only in Source, ' || up || ' with other values.' FROM p
  UNION ALL SELECT 2, 'Rows that share their order_no with another row: ' || dt || ' in Target.' FROM p
  UNION ALL SELECT 3, 'Changed cells lie mainly in ''amount'' (' || n || ').' FROM c
  UNION ALL SELECT 4, 'Mean change of ''amount'': 10.0 (increased in Target).'
  UNION ALL SELECT 5, 'Written otherwise but equal in value: ' || fo || ' records.' FROM p
  UNION ALL SELECT 6, 'Day with most changes: ' || day || '.' FROM busy""", long="pos")
def a22(spark, sf_dir):
    c = b1_comparison(spark, sf_dir)
    c.rows = durable(c.rows)
    return ins.narrative(c, dy.day_summary(c, "2100-01-01")).select(F.col("pos").cast("long").alias("pos"), "sentence")


@query("A29_digest", BUCKETS + """SELECT 'count' AS section, name, CAST(v AS VARCHAR) AS value FROM (UNPIVOT b ON COLUMNS(*) INTO NAME name VALUE v)
  UNION ALL SELECT 'column', column_name, CAST(count(*) AS VARCHAR) FROM cells GROUP BY column_name
  UNION ALL (SELECT 'sample', 'missing_in_target', 'order_no=' || order_no FROM rows WHERE status = 'Deleted' ORDER BY CAST(order_no AS BIGINT) LIMIT 8)
  UNION ALL (SELECT 'sample', 'missing_in_source', 'order_no=' || order_no FROM rows WHERE status = 'Added' ORDER BY CAST(order_no AS BIGINT) LIMIT 8)
  UNION ALL (SELECT 'sample', 'duplicates_target', 'order_no=' || order_no FROM dupt WHERE n > 1 ORDER BY CAST(order_no AS BIGINT) LIMIT 8)""")
def a29(spark, sf_dir):
    return ins.digest(b1_comparison(spark, sf_dir))


# ---- report sheets ------------------------------------------------------------------------------------------------


@query("R1_side_by_side", fx.B1 + """, n AS (SELECT order_no, TRY_CAST(amount AS DECIMAL(18,2)) AS a FROM b1s), m AS (SELECT order_no, TRY_CAST(replace(amount, '$', '') AS DECIMAL(18,2)) AS a FROM b1t)
  SELECT r.status AS "Status", r.order_no, p.s_amount AS before, p.t_amount AS after, CAST(TRY_CAST(p.s_amount AS DECIMAL(18,2)) - TRY_CAST(replace(p.t_amount, '$', '') AS DECIMAL(18,2)) AS DOUBLE) AS gap
  FROM rows r JOIN pairs p ON r.order_no = p.order_no
  UNION ALL SELECT 'Deleted', order_no, amount, '', CAST(TRY_CAST(amount AS DECIMAL(18,2)) AS DOUBLE) FROM b1s WHERE order_no NOT IN (SELECT order_no FROM b1t)
  UNION ALL SELECT 'Added', order_no, '', amount, -CAST(TRY_CAST(amount AS DECIMAL(18,2)) AS DOUBLE) FROM b1t WHERE order_no NOT IN (SELECT order_no FROM b1s)""")
def r1(spark, sf_dir):
    """S-20 included: one-sided rows carry their amount with a sign."""
    c = b1_comparison(spark, sf_dir)
    sheet = rp.side_by_side(c.rows, c.layout)
    return sheet.select(
        "Status", "order_no", F.col("Source — amount").alias("before"), F.col("Target — amount").alias("after"),
        F.col("Amount Difference (Source − Target)").cast("double").alias("gap"),
    )


@query("R2_flat_sheets", fx.B1 + """SELECT 'Deleted — in ''Source'', missing from ''Target''' AS "Status", order_no, amount FROM b1s WHERE order_no NOT IN (SELECT order_no FROM b1t)
  UNION ALL SELECT 'Added — new in ''Target'', not in ''Source''', order_no, amount FROM b1t WHERE order_no NOT IN (SELECT order_no FROM b1s)
  UNION ALL SELECT 'Duplicate key in ''Target''', order_no, amount FROM dupt WHERE n > 1""")
def r2(spark, sf_dir):
    c = b1_comparison(spark, sf_dir)
    parts = [rp.deleted_sheet(c), rp.added_sheet(c), rp.duplicate_sheet(c.duplicates_target, "Target")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("Status", "order_no", "amount")


@query("R3_updated_sheet", fx.B1 + """SELECT 'Updated' AS "Status", p.order_no, 'amount' AS "Changed Columns", s_amount AS before, t_amount AS after, s_cust AS cust
  FROM pairs p JOIN kinds k ON p.order_no = k.order_no WHERE nv > 0""")
def r3(spark, sf_dir):
    sheet = rp.issue_sheet(b1_comparison(spark, sf_dir))
    return sheet.select("Status", "order_no", "Changed Columns", F.col("Source ← amount").alias("before"), F.col("Target → amount").alias("after"), "cust")


@query("R5_summary_sheet", BUCKETS + """, a AS (SELECT (SELECT sum(CAST(amount AS DECIMAL(18,2))) FROM b1s) AS s,
    (SELECT sum(TRY_CAST(replace(t_amount, '$', '') AS DECIMAL(18,2))) FROM pairs) + (SELECT sum(CAST(amount AS DECIMAL(18,2))) FROM b1t WHERE order_no NOT IN (SELECT order_no FROM b1s)) AS t)
  SELECT 'Rows in ''Source''' AS "Metric", CAST(source_record_count AS DOUBLE) AS "Value" FROM b UNION ALL SELECT 'Rows in ''Target''', target_record_count FROM b
  UNION ALL SELECT 'Matched (No Change)', matched FROM b UNION ALL SELECT 'Deleted', missing_in_target FROM b UNION ALL SELECT 'Added', missing_in_source FROM b
  UNION ALL SELECT 'Updated (Value Changes)', mismatches FROM b UNION ALL SELECT 'Renamed (Fuzzy Matched)', 0 FROM b
  UNION ALL SELECT 'Format-Only Differences', format_inconsistencies FROM b UNION ALL SELECT 'Duplicates in ''Source''', duplicates_source FROM b
  UNION ALL SELECT 'Duplicates in ''Target''', duplicates_target FROM b UNION ALL SELECT 'Source Income Total (amount)', CAST(s AS DOUBLE) FROM a
  UNION ALL SELECT 'Target Income Total (amount)', CAST(t AS DOUBLE) FROM a UNION ALL SELECT 'Income Amount Difference (Source − Target)', CAST(s - t AS DOUBLE) FROM a""")
def r5(spark, sf_dir):
    return rp.summary_sheet(b1_comparison(spark, sf_dir)).select("Metric", F.col("Value").cast("double").alias("Value"))


@query("SNK8_report_sheets", fx.B1 + """SELECT 'all_rows' AS sheet, count(*) AS n FROM rows UNION ALL SELECT 'deleted', count(*) FROM rows WHERE status = 'Deleted'
  UNION ALL SELECT 'added', count(*) FROM rows WHERE status = 'Added' UNION ALL SELECT 'updated', count(*) FROM rows WHERE nv > 0 UNION ALL SELECT 'format', count(*) FROM rows WHERE nf > 0
  UNION ALL SELECT 'renamed', 0 UNION ALL SELECT 'schema', 0 UNION ALL SELECT 'summary', 13 UNION ALL SELECT 'day_wise', (SELECT count(*) FROM (SELECT d FROM b1s UNION SELECT d FROM b1t))
  UNION ALL SELECT 'duplicates_source', 0 UNION ALL SELECT 'duplicates_target', (SELECT count(*) FROM dupt WHERE n > 1)""")
def snk8(spark, sf_dir):
    c = b1_comparison(spark, sf_dir)
    c.rows = durable(c.rows)
    tables = rp.sheets(c, dy.day_summary(c, "2100-01-01"))
    folder = scratch(spark, "report")
    rp.write_sheets(tables, folder)
    out = None
    for name in tables:
        part = spark.read.parquet(f"{folder}/{name}").agg(F.lit(name).alias("sheet"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


# ---- ledger filters and pages -------------------------------------------------------------------------------------


@query("F1_exceptions", """SELECT CASE WHEN l_orderkey % 41 = 0 THEN 'blank number' WHEN l_orderkey % 43 = 0 THEN 'no amount' WHEN l_orderkey % 47 = 0 THEN 'blank type' END AS reason, count(*) AS n FROM lineitem GROUP BY 1""")
def f1(spark, sf_dir):
    """A-2 included: the type column is in use on both sides."""
    s = fx.b2_source(spark, sf_dir).withColumn("k", F.col("TxnNumber").cast("long"))
    bad = s.withColumn("TxnNumber", F.when(F.col("k") % 41 == 0, " nan ").otherwise(F.col("TxnNumber"))).withColumn(
        "Amount", F.when(F.col("k") % 43 != 0, F.col("Amount"))
    ).withColumn("TxnType", F.when(F.col("k") % 47 != 0, F.col("TxnType")))
    return lg.flag_exceptions(bad, lg.type_usable(bad, bad)).groupBy("reason").agg(F.count("*").alias("n"))


@query("A1_ledger_groups", """SELECT CAST(l_orderkey AS VARCHAR) AS "TxnNumber", l_returnflag AS "TxnType", CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS "Amount" FROM lineitem GROUP BY ALL""")
def a1(spark, sf_dir):
    return lg.totals_by_key(fx.b2_source(spark, sf_dir)).select("TxnNumber", "TxnType", F.col("Amount").cast("double").alias("Amount"))


@query("F4_mismatch_filter", fx.B2 + """SELECT ns AS "TxnNumber_Source", ty AS "TxnType", CAST(abs(coalesce(sa, 0) - coalesce(ta, 0)) AS DOUBLE) AS gap FROM g
  WHERE abs(coalesce(sa, 0) - coalesce(ta, 0)) > 0.01 AND abs(coalesce(sa, 0) - coalesce(ta, 0)) >= 10000 AND (coalesce(ns, '') || ' ' || coalesce(nt, '')) LIKE '%7%'""")
def f4(spark, sf_dir):
    groups = b2_ledger(spark, sf_dir).groups.drop("Customer_Source", "Customer_Target").withColumn("Customer_Source", F.lit("")).withColumn("Customer_Target", F.lit(""))
    return se.amount_mismatches(groups, "high", text="7").select("TxnNumber_Source", "TxnType", F.col("gap").cast("double").alias("gap"))


@query("F2_search", "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%red%' OR lower(p_brand) LIKE '%red%' OR lower(p_type) LIKE '%red%' OR CAST(p_partkey AS VARCHAR) LIKE '%red%'")
def f2(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return se.search_any(p, " RED ").select("p_partkey")


@query("L1_page", "SELECT o_orderkey FROM orders ORDER BY CAST(o_totalprice AS DECIMAL(18,2)) DESC, o_orderkey LIMIT 50 OFFSET 100")
def l1(spark, sf_dir):
    """L-2 included: the page size 60 snaps to 50."""
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", fx.money("o_totalprice").alias("price"), F.col("o_orderkey").alias("_rid"))
    return se.paginate(o, page=3, page_size=60, sort_by="price", descending=True).items.select("o_orderkey")


@query("L3_preview", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 40 AND o_orderkey < 60")
def l3(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderkey").alias("_rid"))
    return rw.preview_page(o, page=3, page_size=20).select("o_orderkey", "o_orderstatus")


@query("F3_preview_search", "SELECT c_custkey FROM customer WHERE CAST(c_custkey AS VARCHAR) LIKE '%77%' OR lower('c_name:' || c_name || ' c_mktsegment:' || c_mktsegment) LIKE '%77%'")
def f3(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_rid"), "c_name", "c_mktsegment")
    return rw.search_rows(c, "77").select(F.col("_rid").alias("c_custkey"))


# ---- row pairs ----------------------------------------------------------------------------------------------------


def b6(spark, sf_dir):
    """B6: segments (many sites) and customer names (single), with the nation as city."""
    n = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city"))
    c = fx.table(spark, sf_dir, "customer").join(n, "c_nationkey")
    source = c.select(F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.col("c_name")).otherwise("").alias("entity"), "city", F.col("c_custkey").alias("_rid"))
    target = c.where("c_custkey % 10 <> 4").select(
        F.explode(F.array(F.concat(F.col("c_name"), F.lit(" ")), F.when(F.col("c_custkey") % 20 == 0, F.lower("c_mktsegment")))).alias("party"), "city", "c_custkey"
    ).where("party is not null").select("party", "city", (F.col("c_custkey") * 2 + F.col("party").startswith("Customer").cast("long")).alias("_rid"))
    return source, target


_N = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
B6 = f"""WITH c AS (SELECT customer.*, n_name AS city FROM customer JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT c_custkey AS rid, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN c_name ELSE '' END AS name, city FROM c),
t AS (SELECT c_custkey * 2 + 1 AS rid, c_name AS name, city FROM c WHERE c_custkey % 10 <> 4
      UNION ALL SELECT c_custkey * 2, lower(c_mktsegment), city FROM c WHERE c_custkey % 10 <> 4 AND c_custkey % 20 = 0),
tn AS (SELECT {_N.format('name')} AS k, count(*) AS n, min(rid) AS r FROM t GROUP BY 1),
tc AS (SELECT {_N.format('name')} AS k, {_N.format('city')} AS c, count(*) AS n, min(rid) AS r FROM t GROUP BY ALL),
j AS (SELECT s.rid, tn.n AS nn, tn.r AS nr, tc.n AS cn, tc.r AS cr FROM s LEFT JOIN tn ON tn.k = {_N.format('s.name')} AND s.name <> '' LEFT JOIN tc ON tc.k = tn.k AND tc.c = {_N.format('s.city')}),
r AS (SELECT rid, CASE WHEN nn IS NULL THEN 'NO MATCH' WHEN nn = 1 THEN 'Name Only' WHEN cn = 1 THEN 'Name+City' WHEN cn > 1 THEN 'Name+City (Multiple Sites)' ELSE 'Name Only (Multiple Sites)' END AS method,
  coalesce(CASE WHEN nn = 1 THEN 1 WHEN cn IS NOT NULL THEN cn ELSE nn END, 0) AS match_count, CASE WHEN nn = 1 THEN nr WHEN cn = 1 THEN cr END AS target_rid FROM j)
"""


@query("J7_lookup", B6 + "SELECT rid AS source_rid, method, match_count, coalesce(target_rid, -1) AS target_rid FROM r")
def j7(spark, sf_dir):
    s, t = b6(spark, sf_dir)
    return rw.lookup_names(s, t, "entity", "party", "city", "city").select("source_rid", "method", "match_count", or_none("target_rid").alias("target_rid"))


@query("J8_single_pairs", B6 + "SELECT rid AS source_rid, target_rid FROM r WHERE match_count = 1 QUALIFY count(*) OVER (PARTITION BY target_rid) = 1")
def j8_single(spark, sf_dir):
    s, t = b6(spark, sf_dir)
    return rw.single_pairs(rw.lookup_names(s, t, "entity", "party", "city", "city"))


def row_tables(spark, sf_dir):
    """Orders against a reversed copy with changed cells; order k is row k of the source and row n - k of the target."""
    o = fx._orders(spark, sf_dir)
    source = o.select("order_no", "status", F.col("amt").cast("string").alias("Total Amount"), "d", F.col("k").alias("_rid"))
    amount = F.when(F.col("k") % 13 == 0, F.col("amt") + F.lit(5)).when(F.col("k") % 11 == 0, F.col("amt") + F.expr("0.01")).otherwise(F.col("amt")).cast("decimal(18,2)")
    target = o.select(
        F.when(F.col("k") % 17 == 0, "none").otherwise(F.col("order_no")).alias("order_no"),
        F.when(F.col("k") % 19 == 0, F.lower("status")).otherwise(F.col("status")).alias("status"),
        F.concat(F.lit("$"), amount.cast("string")).alias("total_amount"), "d", (F.lit(10_000_000) - F.col("k")).alias("_rid"),
    )
    pairs = o.where("k % 7 <> 0").select(F.col("k").alias("source_rid"), (F.lit(10_000_000) - F.col("k")).alias("target_rid"))
    return source, target, pairs


ROWS = f"""WITH {fx.SQL_ORDERS}, x AS (SELECT k AS source_rid, 'order_no' AS f, order_no AS sv, NULL AS tv, 'MISMATCH' AS st, NULL AS gap FROM o WHERE k % 7 <> 0 AND k % 17 = 0
  UNION ALL SELECT k, 'status', status, lower(status), 'STRING_MISMATCH', NULL FROM o WHERE k % 7 <> 0 AND k % 19 = 0
  UNION ALL SELECT k, 'Total Amount', CAST(amt AS VARCHAR), '$' || CAST(CAST(amt + 5 AS DECIMAL(18,2)) AS VARCHAR), 'NUMERIC_MISMATCH', -5 FROM o WHERE k % 7 <> 0 AND k % 13 = 0)
"""


@query("C5_row_pairs", ROWS + "SELECT source_rid, f AS source_field, sv AS source_value, tv AS target_value, st AS status, CAST(gap AS DOUBLE) AS difference FROM x")
def c5(spark, sf_dir):
    """P-16 included: 'Total Amount' meets 'total_amount'; differences within the tolerance pass."""
    compared = rw.compare_row_pairs(*row_tables(spark, sf_dir))
    return compared.select("source_rid", F.inline("differences")).select(
        "source_rid", "source_field", "source_value", "target_value", "status", F.col("difference").cast("double").alias("difference")
    )


@query("J8_row_pairs", ROWS + """SELECT 'total_source_rows' AS metric, count(*) AS value FROM o UNION ALL SELECT 'total_target_rows', count(*) FROM o
  UNION ALL SELECT 'mapped_pairs_count', count(*) FROM o WHERE k % 7 <> 0 UNION ALL SELECT 'mismatched_pairs_count', (SELECT count(DISTINCT source_rid) FROM x)
  UNION ALL SELECT 'matched_pairs_count', (SELECT count(*) FROM o WHERE k % 7 <> 0) - (SELECT count(DISTINCT source_rid) FROM x)
  UNION ALL SELECT 'unmapped_source_count', count(*) FROM o WHERE k % 7 = 0 UNION ALL SELECT 'unmapped_target_count', count(*) FROM o WHERE k % 7 = 0""")
def j8(spark, sf_dir):
    s, t, pairs = row_tables(spark, sf_dir)
    return rw.pair_summary(s, t, pairs, rw.compare_row_pairs(s, t, pairs))


@query("C6_pair_errors", """WITH o AS (SELECT o_orderkey AS k FROM orders)
  SELECT k AS source_rid, 20000000 - k AS target_rid, 'target row does not exist' AS error FROM o WHERE k % 5 = 0
  UNION ALL SELECT k - k % 2, 10000000 - k, 'source row is used more than once' FROM o WHERE k % 5 <> 0 AND k % 10 IN (2, 3) UNION ALL SELECT k, -1, 'both row numbers are needed' FROM o WHERE k % 100 = 1""")
def c6(spark, sf_dir):
    s, t, _ = row_tables(spark, sf_dir)
    k = F.col("_rid")
    pairs = s.select(
        F.when(k % 10 == 3, k - 1).otherwise(k).alias("source_rid"), F.when(k % 5 == 0, F.lit(20_000_000) - k).otherwise(F.lit(10_000_000) - k).alias("target_rid")
    ).unionByName(s.where("_rid % 100 = 1").select(F.col("_rid").alias("source_rid"), F.lit(None).cast("long").alias("target_rid")))
    return rw.pair_errors(pairs, s, t).withColumn("target_rid", or_none("target_rid"))


# ---- history ------------------------------------------------------------------------------------------------------


def b7_snapshots(spark, sf_dir):
    """B7: baseline and three later versions with shifted moduli."""
    out = hs.snapshot(normalize(fx.b1_source(spark, sf_dir)), KEYS, "s1", 0)
    for v in (1, 2, 3):
        out = out.unionByName(hs.snapshot(normalize(fx.b1_target(spark, sf_dir, v)), KEYS, "s1", v))
    return out


B7 = f"""WITH {fx.SQL_ORDERS}, {fx.SQL_B1_SOURCE}, {fx.sql_b1_target('t1', 1)}, {fx.sql_b1_target('t2', 2)}, {fx.sql_b1_target('t3', 3)},
v AS (SELECT 0 AS version, * FROM b1s UNION ALL SELECT 1, * FROM t1 UNION ALL SELECT 2, * FROM t2 UNION ALL SELECT 3, * FROM t3),
snap AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY version, order_no ORDER BY rid) = 1)"""


@query("SNK3_snapshots", B7 + "SELECT version, order_no AS row_key, amount FROM snap")
def snk3(spark, sf_dir):
    return b7_snapshots(spark, sf_dir).select("version", "row_key", F.col("row_data")["amount"].alias("amount"))


@query("A27_history", B7 + f""", c AS (SELECT *, {fx.sql_canon('amount')} AS canon FROM snap),
  h AS (SELECT order_no FROM c GROUP BY 1 HAVING count(DISTINCT canon) > 1)
  SELECT order_no AS row_key, 'amount' AS column_name, version, amount AS value FROM c WHERE order_no IN (SELECT order_no FROM h)""")
def a27(spark, sf_dir):
    history = hs.value_history(b7_snapshots(spark, sf_dir))
    return history.select("row_key", "column_name", F.explode("values").alias("version", "value"))


@query("L5_most_changed", B7 + f""", c AS (SELECT *, {fx.sql_canon('amount')} AS canon FROM snap)
  SELECT order_no AS row_key, count(DISTINCT amount) AS distinct_values FROM c GROUP BY 1 HAVING count(DISTINCT canon) > 1 ORDER BY 2 DESC, 1 LIMIT 100""")
def l5(spark, sf_dir):
    return hs.most_changed_first(hs.value_history(b7_snapshots(spark, sf_dir))).limit(100).select("row_key", F.col("distinct_values").cast("long").alias("distinct_values"))
