"""Source/target table pairs derived from the whole test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablematch.sources.ordinal import with_ordinal_by

AS_OF = "2000-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c) -> F.Column:
    return F.col(c).cast("decimal(18,2)")


# ---- B1: master pair over orders; `shift` moves the moduli for later versions -------------------------------------

_B1_COLUMNS = ["order_no", "cust", "status", "amount", "d", "_rid"]


def _orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.col("o_orderkey").cast("string").alias("order_no"),
        F.col("o_custkey").cast("string").alias("cust"),
        F.col("o_orderstatus").alias("status"),
        money("o_totalprice").alias("amt"),
        F.col("o_orderdate").cast("date").cast("string").alias("d"),
    )


def b1_source(spark, sf_dir) -> DataFrame:
    o = _orders(spark, sf_dir)
    return o.select("order_no", "cust", "status", F.col("amt").cast("string").alias("amount"), "d", (F.col("k") * 10).alias("_rid"))


def b1_target(spark, sf_dir, shift: int = 0) -> DataFrame:
    o = _orders(spark, sf_dir).withColumn("j", F.col("k") + shift)
    text = F.col("amt").cast("string")
    amount = (
        F.when(F.col("j") % 13 == 0, (F.col("amt") + 10).cast("decimal(18,2)").cast("string"))
        .when(F.col("j") % 11 == 0, F.concat(F.lit("$"), text, F.lit("0")))
        .otherwise(text)
    )
    kept = o.where("j % 17 <> 0").select("order_no", "cust", "status", amount.alias("amount"), "d", (F.col("k") * 10).alias("_rid"))
    new = o.where("j % 19 = 0").select(
        (F.col("k") + 10000000).cast("string").alias("order_no"), "cust", "status", text.alias("amount"), "d",
        ((F.col("k") + 10000000) * 10).alias("_rid"),
    )
    twice = o.where("j % 23 = 0 and j % 17 <> 0 and j % 11 <> 0 and j % 13 <> 0").select(
        "order_no", "cust", "status", text.alias("amount"), "d", (F.col("k") * 10 + 1).alias("_rid")
    )
    return kept.unionByName(new).unionByName(twice)


SQL_ORDERS = """o AS (
  SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS order_no, CAST(o_custkey AS VARCHAR) AS cust,
         o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS amt,
         CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders)"""

SQL_B1_SOURCE = "b1s AS (SELECT order_no, cust, status, CAST(amt AS VARCHAR) AS amount, d, k*10 AS rid FROM o)"


def sql_b1_target(name: str = "b1t", shift: int = 0) -> str:
    return f"""{name} AS (
  SELECT order_no, cust, status, CASE WHEN (k+{shift}) % 13 = 0 THEN CAST(CAST(amt+10 AS DECIMAL(18,2)) AS VARCHAR)
         WHEN (k+{shift}) % 11 = 0 THEN '$' || CAST(amt AS VARCHAR) || '0' ELSE CAST(amt AS VARCHAR) END AS amount, d, k*10 AS rid
  FROM o WHERE (k+{shift}) % 17 <> 0
  UNION ALL SELECT CAST(k+10000000 AS VARCHAR), cust, status, CAST(amt AS VARCHAR), d, (k+10000000)*10 FROM o WHERE (k+{shift}) % 19 = 0
  UNION ALL SELECT order_no, cust, status, CAST(amt AS VARCHAR), d, k*10+1 FROM o
  WHERE (k+{shift}) % 23 = 0 AND (k+{shift}) % 17 <> 0 AND (k+{shift}) % 11 <> 0 AND (k+{shift}) % 13 <> 0)"""


def sql_bare(x: str) -> str:
    return f"ltrim(replace(trim({x}), ',', ''), '$')"


def sql_canon(x: str) -> str:
    """Canonical value for the texts that occur in the fixtures (plain numbers, ISO dates, words)."""
    return (
        f"CASE WHEN trim({x}) = '' THEN '' "
        f"WHEN TRY_CAST({sql_bare(x)} AS DECIMAL(38,12)) IS NOT NULL "
        f"THEN 'number:' || rtrim(rtrim(CAST(TRY_CAST({sql_bare(x)} AS DECIMAL(38,12)) AS VARCHAR), '0'), '.') "
        f"WHEN TRY_CAST(trim({x}) AS DATE) IS NOT NULL THEN 'date:' || CAST(TRY_CAST(trim({x}) AS DATE) AS VARCHAR) "
        f"ELSE 'text:' || lower(trim({x})) END"
    )


def sql_kind(a: str, b: str) -> str:
    return f"CASE WHEN trim({a}) = trim({b}) THEN NULL WHEN {sql_canon(a)} = {sql_canon(b)} THEN 'format' ELSE 'value' END"


def sql_cells(pairs: str, key: str, columns: list[str]) -> str:
    """Long table of differing cells of a pair table with s_<col> and t_<col>."""
    parts = [
        f"SELECT {key}, '{c}' AS column_name, s_{c} AS source_value, t_{c} AS target_value, "
        f"{sql_kind(f's_{c}', f't_{c}')} AS kind FROM {pairs}"
        for c in columns
    ]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE kind IS NOT NULL"


def sql_master(source: str = "b1s", target: str = "b1t", p: str = "") -> str:
    """CTEs pairs, cells, rows of the master comparison of two order tables, prefixed with `p`."""
    cols = ["cust", "status", "amount", "d"]
    both = ", ".join(f"s.{c} AS s_{c}, t.{c} AS t_{c}" for c in cols)
    return f"""
{p}s1 AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY order_no ORDER BY rid) = 1),
{p}t1 AS (SELECT * FROM {target} QUALIFY row_number() OVER (PARTITION BY order_no ORDER BY rid) = 1),
{p}pairs AS (SELECT s.order_no, {both} FROM {p}s1 s JOIN {p}t1 t ON s.order_no = t.order_no),
{p}cells AS ({sql_cells(p + 'pairs', 'order_no', cols)}),
{p}kinds AS (SELECT order_no, count(*) FILTER (kind = 'value') AS nv, count(*) FILTER (kind = 'format') AS nf FROM {p}cells GROUP BY 1),
{p}rows AS (
  SELECT p.order_no, CASE WHEN nv > 0 THEN 'Updated' WHEN nf > 0 THEN 'Format Only' ELSE 'Matched' END AS status,
         coalesce(nv, 0) AS nv, coalesce(nf, 0) AS nf, s_d AS d FROM {p}pairs p LEFT JOIN {p}kinds k ON p.order_no = k.order_no
  UNION ALL SELECT order_no, 'Deleted', 0, 0, d FROM {source} WHERE order_no NOT IN (SELECT order_no FROM {target})
  UNION ALL SELECT order_no, 'Added', 0, 0, d FROM {target} WHERE order_no NOT IN (SELECT order_no FROM {source})),
{p}dups AS (SELECT order_no, d, count(*) OVER (PARTITION BY order_no) AS n FROM {source}),
{p}dupt AS (SELECT order_no, d, amount, count(*) OVER (PARTITION BY order_no) AS n FROM {target})"""


B1 = f"WITH {SQL_ORDERS},\n{SQL_B1_SOURCE},\n{sql_b1_target()},{sql_master()}\n"


# ---- B2: ledger pair over lineitem --------------------------------------------------------------------------------


def _ledger_lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        F.col("l_returnflag").alias("TxnType"),
        F.col("l_shipdate").cast("date").alias("TxnDate"),
        money("l_extendedprice").alias("amt"),
        F.col("l_suppkey").cast("string").alias("Customer"),
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("_rid"),
    )


def b2_source(spark, sf_dir) -> DataFrame:
    return _ledger_lines(spark, sf_dir).select(
        F.col("k").cast("string").alias("TxnNumber"), "TxnType", "TxnDate", F.col("amt").alias("Amount"), "Customer", "_rid"
    )


def b2_target(spark, sf_dir) -> DataFrame:
    number = F.when(F.col("k") % 29 == 0, F.concat(F.col("k").cast("string"), F.lit("-1"))).otherwise(F.col("k").cast("string"))
    amount = F.when(F.col("k") % 13 == 0, F.col("amt") + 1).otherwise(F.col("amt")).cast("decimal(18,2)")
    return _ledger_lines(spark, sf_dir).where("k % 17 <> 0").select(
        number.alias("TxnNumber"), "TxnType", "TxnDate", amount.alias("Amount"), "Customer", "_rid"
    )


B2 = """WITH l AS (SELECT l_orderkey AS k, l_returnflag AS ty, CAST(l_extendedprice AS DECIMAL(18,2)) AS amt FROM lineitem),
s AS (SELECT CAST(k AS VARCHAR) AS num, ty, amt FROM l),
t AS (SELECT CAST(k AS VARCHAR) || CASE WHEN k % 29 = 0 THEN '-1' ELSE '' END AS num, ty,
             CAST(amt + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS amt FROM l WHERE k % 17 <> 0),
sg AS (SELECT num, ty, sum(amt) AS a, count(*) AS n FROM s GROUP BY ALL),
tg AS (SELECT num, ty, sum(amt) AS a, count(*) AS n FROM t GROUP BY ALL),
j AS (SELECT coalesce(sg.num, tg.num) AS num, coalesce(sg.ty, tg.ty) AS ty, sg.a AS sa, tg.a AS ta,
             CASE WHEN tg.num IS NULL THEN 'Only In Source' WHEN sg.num IS NULL THEN 'Only In Target'
                  WHEN abs(sg.a - tg.a) <= 0.01 THEN 'Matched' ELSE 'Amount Mismatch' END AS st
      FROM sg FULL JOIN tg ON sg.num = tg.num AND sg.ty = tg.ty),
o AS (SELECT *, regexp_replace(num, '-[0-9]+$', '') AS stem FROM j WHERE st LIKE 'Only%'),
o2 AS (SELECT *, count(*) FILTER (st = 'Only In Source') OVER w AS ns, count(*) FILTER (st = 'Only In Target') OVER w AS nt
       FROM o WINDOW w AS (PARTITION BY stem, ty)),
tier2 AS (SELECT a.num AS ns, b.num AS nt, a.ty, a.sa, b.ta, CASE WHEN abs(a.sa - b.ta) <= 0.01 THEN 'Tier2 Match' ELSE 'Tier2 Amount Mismatch' END AS st
          FROM o2 a JOIN o2 b ON a.stem = b.stem AND a.ty = b.ty
          WHERE a.st = 'Only In Source' AND b.st = 'Only In Target' AND a.ns = 1 AND a.nt = 1),
g AS (SELECT num AS ns, num AS nt, ty, sa, ta, st FROM j WHERE st NOT LIKE 'Only%'
      UNION ALL SELECT CASE WHEN st = 'Only In Source' THEN num END, CASE WHEN st = 'Only In Target' THEN num END, ty, sa, ta, st
      FROM o2 WHERE NOT (ns = 1 AND nt = 1)
      UNION ALL SELECT ns, nt, ty, sa, ta, st FROM tier2)
"""


# ---- B3: line pair over lineitem ----------------------------------------------------------------------------------

_LINE_ORDER = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]
_FAR = 1_000_000_000_000


def _lines(spark, sf_dir) -> DataFrame:
    """The lines with their position in the order of all columns, over the whole table."""
    cells = [
        F.col("l_orderkey").cast("string").alias("order_no"),
        F.col("l_linenumber").cast("string").alias("line"),
        money("l_quantity").alias("qty"),
        money("l_extendedprice").alias("price"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_shipdate").cast("date").cast("string").alias("ship_date"),
    ]
    return with_ordinal_by(table(spark, sf_dir, "lineitem").select(*_LINE_ORDER), _LINE_ORDER, "r", cells)


def b3_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    lines = _lines(spark, sf_dir)
    qty, price = F.col("qty").cast("string"), F.col("price").cast("string")
    source = lines.select("order_no", "line", qty.alias("qty"), price.alias("price"), "flag", "ship_date", F.col("r").alias("_rid"))
    new_qty = F.when(F.col("r") % 13 == 0, (F.col("qty") + 1).cast("decimal(18,2)").cast("string")).otherwise(qty)
    new_price = F.when(F.col("r") % 11 == 0, F.concat(F.lit("$"), price, F.lit("0"))).otherwise(price)
    kept = lines.where("r % 17 <> 0").select(
        "order_no", "line", new_qty.alias("qty"), new_price.alias("price"), "flag", "ship_date", (F.lit(_FAR) - F.col("r") * 2).alias("_rid")
    )
    extra = lines.where("r % 19 = 0").select(
        "order_no", "line", qty.alias("qty"), F.lit("0.00").alias("price"), "flag", "ship_date", (F.lit(_FAR) - F.col("r") * 2 + 1).alias("_rid")
    )
    return source, kept.unionByName(extra)


_LINE_COLS = ["line", "qty", "price", "flag", "ship_date"]
_canon_print = " || '|' || ".join(sql_canon(c) for c in _LINE_COLS)
_pair_cols = ", ".join(f"s.{c} AS s_{c}, t.{c} AS t_{c}" for c in _LINE_COLS)
B3 = f"""WITH l AS (SELECT row_number() OVER (ORDER BY {', '.join(_LINE_ORDER)}) - 1 AS r, CAST(l_orderkey AS VARCHAR) AS order_no,
  CAST(l_linenumber AS VARCHAR) AS line, CAST(l_quantity AS DECIMAL(18,2)) AS q, CAST(l_extendedprice AS DECIMAL(18,2)) AS p,
  l_returnflag AS flag, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS ship_date FROM lineitem),
s0 AS (SELECT order_no, line, CAST(q AS VARCHAR) AS qty, CAST(p AS VARCHAR) AS price, flag, ship_date, r AS rid FROM l),
t0 AS (SELECT order_no, line, CASE WHEN r % 13 = 0 THEN CAST(CAST(q + 1 AS DECIMAL(18,2)) AS VARCHAR) ELSE CAST(q AS VARCHAR) END AS qty,
         CASE WHEN r % 11 = 0 THEN '$' || CAST(p AS VARCHAR) || '0' ELSE CAST(p AS VARCHAR) END AS price, flag, ship_date,
         {_FAR} - r * 2 AS rid FROM l WHERE r % 17 <> 0
       UNION ALL SELECT order_no, line, CAST(q AS VARCHAR), '0.00', flag, ship_date, {_FAR} - r * 2 + 1 FROM l WHERE r % 19 = 0),
s1 AS MATERIALIZED (SELECT *, {_canon_print} AS fp FROM s0), t1 AS MATERIALIZED (SELECT *, {_canon_print} AS fp FROM t0),
s2 AS (SELECT *, row_number() OVER (PARTITION BY order_no, fp ORDER BY rid) AS n FROM s1),
t2 AS (SELECT *, row_number() OVER (PARTITION BY order_no, fp ORDER BY rid) AS n FROM t1),
exact AS MATERIALIZED (SELECT s.rid AS sr, t.rid AS tr FROM s2 s JOIN t2 t ON s.order_no = t.order_no AND s.fp = t.fp AND s.n = t.n),
s3 AS (SELECT *, row_number() OVER (PARTITION BY order_no ORDER BY rid) AS m FROM s1 ANTI JOIN exact ON rid = sr),
t3 AS (SELECT *, row_number() OVER (PARTITION BY order_no ORDER BY rid) AS m FROM t1 ANTI JOIN exact ON rid = tr),
links AS MATERIALIZED (SELECT * FROM exact UNION ALL SELECT s3.rid, t3.rid FROM s3 FULL JOIN t3 ON s3.order_no = t3.order_no AND s3.m = t3.m),
pairs AS MATERIALIZED (SELECT s.order_no, s.rid AS s_rid, t.rid AS t_rid, {_pair_cols} FROM links x JOIN s1 s ON x.sr = s.rid JOIN t1 t ON x.tr = t.rid),
cells AS ({sql_cells('pairs', 's_rid', _LINE_COLS)}),
kinds AS (SELECT s_rid, count(*) FILTER (kind = 'value') AS nv, count(*) FILTER (kind = 'format') AS nf FROM cells GROUP BY 1),
rows AS (
  SELECT order_no, p.s_rid, t_rid, CASE WHEN nv > 0 THEN 'Updated' WHEN nf > 0 THEN 'Format Only' ELSE 'Matched' END AS status,
         coalesce(nv, 0) + coalesce(nf, 0) AS changed FROM pairs p LEFT JOIN kinds k ON p.s_rid = k.s_rid
  UNION ALL SELECT order_no, rid, NULL, 'Deleted', 0 FROM s1 SEMI JOIN (SELECT sr FROM links WHERE tr IS NULL) ON rid = sr
  UNION ALL SELECT order_no, NULL, rid, 'Added', 0 FROM t1 SEMI JOIN (SELECT tr FROM links WHERE sr IS NULL) ON rid = tr)
"""
