"""Version chains, run metrics, streams, mapping profiles."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.comparisons import KEYS, or_none
from checks.analysis import B7, ROWS, row_tables
from checks.registry import query
from checks.scans import scratch
from tablematch.operators import history as hs
from tablematch.operators import metrics as mt
from tablematch.operators import report as rp
from tablematch.operators import search as se
from tablematch.operators.align import align
from tablematch.sources import catalog as ct
from tablematch.sources import readers as rd
from tablematch.streaming import keyed as kd
from tablematch.streaming.compare import compare, compare_rows, follow, follow_against, store_version

AT = datetime.datetime(2000, 1, 1)


def chain(spark, sf_dir, versions: int = 3, report: bool = False):
    """Version store with the baseline and later versions of the orders (B7)."""
    store = ct.VersionStore(spark, scratch(spark, "store"))
    store_version(store, "s1", fx.b1_source(spark, sf_dir), "orders.csv", AT, KEYS, name="orders")
    for v in range(1, versions + 1):
        at = AT + datetime.timedelta(days=v)
        store_version(store, "s1", fx.b1_target(spark, sf_dir, v), f"orders-{v}.csv", at, data_type="master", similar=False, report=report)
    return store


def _steps(n: int) -> str:
    """SQL: counts of each version of the chain against the one before."""
    names = ["b1s", "t1", "t2", "t3"]
    ctes = "".join("," + fx.sql_master(names[i - 1], names[i], f"c{i}_") for i in range(1, n + 1))
    rows = " UNION ALL ".join(
        f"SELECT {i} AS version, (SELECT count(*) FROM c{i}_rows WHERE status = 'Added') AS added, "
        f"(SELECT count(*) FROM c{i}_rows WHERE status = 'Deleted') AS deleted, (SELECT count(*) FROM c{i}_rows WHERE nv > 0) AS updated, "
        f"(SELECT count(*) FROM c{i}_rows WHERE nf > 0) AS format_issues, (SELECT count(*) FROM c{i}_dups WHERE n > 1) + (SELECT count(*) FROM c{i}_dupt WHERE n > 1) AS duplicates, "
        f"(SELECT count(*) FROM {names[i - 1]}) AS source_records, (SELECT count(*) FROM {names[i]}) AS target_records"
        for i in range(1, n + 1)
    )
    return B7 + ctes + f", ver AS ({rows})\n"


METRICS = _steps(3) + """, m0 AS (SELECT *, greatest(source_records, target_records) AS total FROM ver),
m1 AS (SELECT *, greatest(total - updated - added - deleted - format_issues, 0) AS matched FROM m0),
m2 AS (SELECT *, 100.0 * matched / total AS match_rate, 100.0 * duplicates / target_records AS duplicate_rate, 100.0 * deleted / total AS missing_rate FROM m1),
m AS (SELECT *, greatest(0, least(100, match_rate - duplicate_rate * 0.5 - missing_rate * 0.3)) AS quality FROM m2)
"""


@query("SNK4_version_chain", _steps(2) + "SELECT version, added, deleted, updated, 0 AS renamed, format_issues, target_records AS row_count, 'Day ' || version AS label FROM ver UNION ALL SELECT 0, 0, 0, 0, 0, 0, count(*), 'Source' FROM b1s", long="renamed")
def snk4(spark, sf_dir):
    """Create, append, timeline; each version is compared with its predecessor (T-2 in batch)."""
    store = chain(spark, sf_dir, 2)
    return ct.series_timeline(store.versions(), "s1").drop("uploaded_at")


@query("SRC3_version_scan", B7 + "SELECT order_no, amount FROM t2")
def src3(spark, sf_dir):
    return chain(spark, sf_dir, 2).read("s1", 2).select("order_no", "amount")


@query("SNK2_stored_diff", _steps(1) + "SELECT order_no, status, CAST(nv + nf AS BIGINT) AS changed FROM c1_rows")
def snk2(spark, sf_dir):
    diff = chain(spark, sf_dir, 1).read_diff("s1", 1)
    return diff.select(F.col("key")["order_no"].alias("order_no"), "status", F.size("changed_columns").cast("long").alias("changed"))


@query("A27_intervals", B7 + f""", keys AS (SELECT DISTINCT order_no FROM snap), g AS (SELECT k.order_no, x.version, s.amount FROM keys k CROSS JOIN range(4) x(version)
  LEFT JOIN snap s ON s.order_no = k.order_no AND s.version = x.version),
  e AS (SELECT *, CASE WHEN lag(amount) OVER w IS DISTINCT FROM amount THEN 1 ELSE 0 END AS begins FROM g WINDOW w AS (PARTITION BY order_no ORDER BY version)),
  i AS (SELECT *, sum(begins) OVER (PARTITION BY order_no ORDER BY version) AS run FROM e),
  r AS (SELECT order_no, run, min(version) AS valid_from, max(version) + 1 AS valid_to, any_value(amount) AS value FROM i GROUP BY ALL),
  h AS (SELECT order_no FROM (SELECT order_no, {fx.sql_canon('amount')} AS canon FROM snap) GROUP BY 1 HAVING count(DISTINCT canon) > 1)
  SELECT order_no AS row_key, 'amount' AS column_name, CAST(valid_from AS INT) AS valid_from, CAST(CASE WHEN valid_to < 4 THEN valid_to END AS INT) AS valid_to, value
  FROM r WHERE value IS NOT NULL AND order_no IN (SELECT order_no FROM h)""")
def a27_intervals(spark, sf_dir):
    """The history of a stored chain from its changes, two of three runs compacted."""
    store = chain(spark, sf_dir, 2)
    store.compact_changes("s1")
    at = AT + datetime.timedelta(days=3)
    store_version(store, "s1", fx.b1_target(spark, sf_dir, 3), "orders-3.csv", at, data_type="master", similar=False)
    return hs.value_intervals(store.changes("s1")).drop("series_id", "changed")


@query("W5_previous_version", "SELECT * FROM (VALUES (0, -1), (1, 0), (2, 1)) t(version, previous_version), (SELECT count(*) AS n FROM orders)")
def w5(spark, sf_dir):
    versions = chain(spark, sf_dir, 2).versions()
    first = versions.where("version = 0").agg(F.max("row_count")).scalar()
    return mt.previous_versions(versions).select("version", F.coalesce("previous_version", F.lit(-1)).alias("previous_version")).withColumn("n", first)


@query("A23_run_metrics", METRICS + """SELECT version, total, matched, updated, added AS inserted, deleted AS missing, duplicates, round(match_rate, 6) AS match_rate, round(duplicate_rate, 6) AS duplicate_rate,
  round(missing_rate, 6) AS missing_rate, round(quality, 6) AS quality_score, round(quality - lag(quality) OVER (ORDER BY version), 6) AS quality_delta FROM m""")
def a23(spark, sf_dir):
    """W-6 included: change of the quality score."""
    m = mt.run_metrics(chain(spark, sf_dir).versions())
    rates = ["match_rate", "duplicate_rate", "missing_rate", "quality_score", "quality_delta"]
    return m.select("version", "total", "matched", "updated", "inserted", "missing", "duplicates", *[F.round(r, 6).alias(r) for r in rates])


@query("A24_range", METRICS + """SELECT count(*) AS runs, round(avg(match_rate), 6) AS avg_match_rate, round(avg(duplicate_rate), 6) AS avg_duplicate_rate, round(avg(quality), 6) AS avg_quality_score,
  sum(matched) AS matched, sum(updated) AS updated, round(max(match_rate) FILTER (version = 3) - max(match_rate) FILTER (version = 1), 6) AS match_rate_change,
  round(max(quality) FILTER (version = 3) - max(quality) FILTER (version = 1), 6) AS quality_score_change FROM m""", long="matched updated")
def a24(spark, sf_dir):
    r = mt.range_comparison(mt.run_metrics(chain(spark, sf_dir).versions()), 3, 1)
    rates = ["avg_match_rate", "avg_duplicate_rate", "avg_quality_score", "match_rate_change", "quality_score_change"]
    return r.select("runs", "matched", "updated", *[F.round(c, 6).alias(c) for c in rates])


@query("A25_run_points", _steps(3) + "SELECT version AS run_no, 'R' || version AS run_id, updated, added AS inserted, deleted AS missing, greatest(10, max(greatest(updated, added, deleted)) OVER ()) AS largest, sum(updated) OVER () AS total_updated FROM ver QUALIFY version >= 2", long="total_updated")
def a25(spark, sf_dir):
    """F-5 included: the last two runs, next to the totals of all runs."""
    points = mt.run_points(chain(spark, sf_dir).versions())
    t = mt.run_totals(points)
    return (
        se.filter_runs(points, last=2).select("run_no", "run_id", "updated", "inserted", "missing")
        .withColumn("largest", t.select("largest").scalar()).withColumn("total_updated", t.select("updated").scalar())
    )


@query("F5_run_filter", _steps(2) + "SELECT version AS run_no, updated FROM ver WHERE version = 2")
def f5(spark, sf_dir):
    return se.filter_runs(mt.run_points(chain(spark, sf_dir, 2).versions()), run="run-2").select("run_no", "updated")


@query("A26_activity", _steps(2) + "SELECT 3 AS files, 1 AS comparisons, 2 AS reports, 3 AS last_week, 3 AS recent, sum(target_records) AS records FROM ver", long="files comparisons reports last_week recent records")
def a26(spark, sf_dir):
    v = chain(spark, sf_dir, 2, report=True).versions()
    return (
        mt.activity(v, "2000-01-05").withColumn("recent", mt.recent_events(v).agg(F.count("*")).scalar())
        .withColumn("records", v.agg(F.sum("target_records")).scalar())
    )


@query("A28_progression", _steps(2) + "SELECT version AS day, false AS is_source, added + deleted + updated AS total_changes FROM ver UNION ALL SELECT 0, true, -1")
def a28(spark, sf_dir):
    return mt.progression(chain(spark, sf_dir, 2).versions()).select("day", "is_source", or_none("total_changes").alias("total_changes"))


@query("R6_grouped_reports", "SELECT 's1' AS group_id, 'orders' AS title, 2 AS reports, 's1_v1,s1_v2' AS files, count(*) AS n FROM orders", long="reports")
def r6(spark, sf_dir):
    v = chain(spark, sf_dir, 2, report=True).versions()
    rows = v.where("version = 0").agg(F.max("row_count")).scalar()
    return rp.grouped_reports(v).withColumn("files", F.array_join("files", ",")).withColumn("n", rows)


@query("SNK4_series_list", "SELECT 's1' AS series_id, 3 AS version_count, 2 AS target_count, 'Day 2' AS latest_label, 'orders' AS name, 3 AS files, count(*) AS n FROM orders", long="version_count target_count files")
def snk4_list(spark, sf_dir):
    v = chain(spark, sf_dir, 2).versions()
    rows = v.where("version = 0").agg(F.max("row_count")).scalar()
    files = mt.largest_series(v).select("series_id", "files")
    listed = ct.list_series(v).select("series_id", "version_count", "target_count", "latest_label", "name")
    return listed.join(files, "series_id").withColumn("n", rows)


@query("SNK7_mapping_profile", "SELECT c_custkey, c_name, 2 AS version FROM customer")
def snk7(spark, sf_dir):
    """A stored mapping, saved twice, read back and used on the next file of the same system."""
    path = scratch(spark, "profiles")
    ct.save_profile(spark, path, "crm", "HEADER_COLUMN", [{"source_column": "c_custkey", "target_column": "wrong"}])
    items = [{"source_column": "c_custkey", "target_column": "K1", "is_key": True}, {"source_column": "c_name", "target_column": "N1"}]
    ct.save_profile(spark, path, "crm", "HEADER_COLUMN", items)
    profile = ct.load_profile(spark, path, "crm").collect()
    target = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("K1"), F.col("c_name").alias("N1"))
    source = spark.createDataFrame([], "c_custkey long, c_name string")
    return align(source, target, {r.source_column: r.target_column for r in profile}).withColumn("version", F.lit(profile[0].version))


@query("SNK7_row_profile", ROWS + """, m AS (SELECT count(*) FILTER (k % 7 <> 0) AS mapped, count(*) AS n FROM o), bad AS (SELECT count(DISTINCT source_rid) AS n FROM x)
  SELECT 'total_source_rows' AS metric, n AS value FROM m UNION ALL SELECT 'total_target_rows', n FROM m UNION ALL SELECT 'mapped_pairs_count', mapped FROM m
  UNION ALL SELECT 'mismatched_pairs_count', n FROM bad UNION ALL SELECT 'matched_pairs_count', mapped - bad.n FROM m, bad
  UNION ALL SELECT 'unmapped_source_count', n - mapped FROM m UNION ALL SELECT 'unmapped_target_count', n - mapped FROM m
  UNION ALL SELECT 'differences', count(*) FROM x UNION ALL SELECT 'version', 2""")
def snk7_rows(spark, sf_dir):
    """Row pairs stored as a profile, in a second version, and replayed on the two tables (row-index mode)."""
    path = scratch(spark, "profiles")
    source, target, pairs = row_tables(spark, sf_dir)
    ct.save_row_pairs(pairs.where("source_rid % 2 = 0"), path, "rows")
    ct.save_row_pairs(pairs, path, "rows")
    profile = ct.load_profile(spark, path, "rows")
    compared, summary = compare_rows(source, target, ct.row_pairs(profile))
    found = compared.agg(F.sum(F.size("differences")).cast("long").alias("value")).select(F.lit("differences").alias("metric"), "value")
    version = profile.agg(F.max("version").cast("long").alias("value")).select(F.lit("version").alias("metric"), "value")
    return summary.unionByName(found).unionByName(version)


def _arrive(df, folder: str, part: int) -> None:
    """An arrival of as many files as its table has parts; one micro-batch takes them all."""
    df.write.mode("append").parquet(f"{folder}/part={part}")


@query("T2_version_stream", _steps(2) + "SELECT version, added, deleted, updated, format_issues FROM ver UNION ALL SELECT 0, 0, 0, 0, 0")
def t2(spark, sf_dir):
    """Files that arrive one after the other; each batch is compared with the version before."""
    inbox, store = scratch(spark, "inbox"), ct.VersionStore(spark, scratch(spark, "store"))
    checkpoint = scratch(spark, "progress")
    schema = fx.b1_source(spark, sf_dir).schema
    for v in range(3):
        table = fx.b1_source(spark, sf_dir) if v == 0 else fx.b1_target(spark, sf_dir, v)
        _arrive(table, inbox, v)
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(inbox)
        follow(stream, store, "s1", checkpoint, keys=KEYS, data_type="master", similar=False).awaitTermination()
    return ct.series_timeline(store.versions(), "s1").select("version", "added", "deleted", "updated", "format_issues")


@query("T2_keyed_state", _steps(2) + """SELECT 0 AS version, order_no AS row_key, 'Added' AS status FROM b1s
UNION ALL SELECT DISTINCT 1, order_no, CASE WHEN nv > 0 THEN 'Updated' WHEN status IN ('Added', 'Deleted') THEN status ELSE 'Matched' END FROM c1_rows
UNION ALL SELECT DISTINCT 2, order_no, CASE WHEN nv > 0 THEN 'Updated' WHEN status IN ('Added', 'Deleted') THEN status ELSE 'Matched' END FROM c2_rows""", long="version")
def t2_keyed(spark, sf_dir):
    """The same chain row by row: fingerprints in keyed state instead of the version before, markers that end a version."""
    inbox, results, progress = (scratch(spark, x) for x in ("inbox", "results", "progress"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before, buckets = spark.conf.get(provider), 0
    spark.conf.set(provider, kd.STATE_STORE)
    try:
        for v in range(3):
            table = (fx.b1_source(spark, sf_dir) if v == 0 else fx.b1_target(spark, sf_dir, v)).drop("_rid").withColumn("version", F.lit(v).cast("long"))
            marker = spark.createDataFrame([(None, None, None, None, None, v)], table.schema)
            _arrive(table.unionByName(marker), inbox, v)
            buckets = buckets or kd.buckets_for(table.count())
            stream = spark.readStream.schema(table.schema).option("recursiveFileLookup", True).parquet(inbox)
            judged = kd.judge_arrivals(stream, KEYS, buckets=buckets).writeStream.format("parquet").option("checkpointLocation", progress).option("path", results)
            judged.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(kd.CHANGES).parquet(results).select("version", "row_key", "status")


@query("T2_several_arrivals", _steps(2) + "SELECT version, label, added, deleted, updated, format_issues FROM (SELECT version, 'Day ' || version AS label, added, deleted, updated, format_issues FROM ver) UNION ALL SELECT 0, 'Source', 0, 0, 0, 0")
def t2_arrivals(spark, sf_dir):
    """Three arrivals in one micro-batch are three versions, in order of arrival."""
    inbox, store = scratch(spark, "inbox"), ct.VersionStore(spark, scratch(spark, "store"))
    for v in (2, 0, 1):
        table = fx.b1_source(spark, sf_dir) if v == 0 else fx.b1_target(spark, sf_dir, v)
        at = F.lit(AT + datetime.timedelta(days=v))
        _arrive(table.withColumn("batch_id", F.lit(f"b{9 - v}")).withColumn("uploaded_at", at), inbox, v)
    stream = spark.readStream.schema(spark.read.parquet(f"{inbox}/part=0").schema).option("recursiveFileLookup", True).parquet(inbox)
    follow(
        stream, store, "s1", scratch(spark, "progress"), lambda df: df.drop("batch_id", "uploaded_at"), arrival="batch_id", keys=KEYS,
        data_type="master", similar=False,
    ).awaitTermination()
    return ct.series_timeline(store.versions(), "s1").select("version", "label", "added", "deleted", "updated", "format_issues")


@query("SNK4_stored_report", _steps(2) + "SELECT metric, n FROM (SELECT added AS \"Added\", deleted AS \"Deleted\", updated AS \"Updated (Value Changes)\" FROM ver WHERE version = 2) UNPIVOT (n FOR metric IN (\"Added\", \"Deleted\", \"Updated (Value Changes)\"))", long="n")
def snk4_report(spark, sf_dir):
    """The summary sheet that was written with the second version, read back by the name in the catalogue."""
    store = chain(spark, sf_dir, 2, report=True)
    name = store.latest("s1")["report_file"]
    sheet = store.read_sheet(name, "summary").toDF("metric", "n")
    return sheet.where(F.col("metric").isin("Added", "Deleted", "Updated (Value Changes)")).select("metric", F.col("n").cast("double").cast("long").alias("n"))


@query("T1_periodic_compare", _steps(1) + "SELECT version, added, deleted, updated, format_issues FROM ver")
def t1(spark, sf_dir):
    """A staged source arrives and is compared with the target as it is then."""
    inbox, store = scratch(spark, "inbox"), ct.VersionStore(spark, scratch(spark, "store"))
    staging = scratch(spark, "staging")
    source = fx.b1_source(spark, sf_dir).withColumnRenamed("_rid", "rid")
    ct.stage_rows(source, staging, "p", "orders", "order_no", "b1", F.lit("2000-01-01").cast("timestamp"))
    _arrive(ct.staged(spark, staging), inbox, 0)

    def prepare(batch):
        names = ["order_no", "cust", "status", "amount", "d", "rid"]
        return rd.records_to_columns(rd.latest_batch(batch), names).withColumn("_rid", F.col("rid").cast("long")).drop("rid")

    stream = spark.readStream.schema(ct.STAGED_SCHEMA).option("recursiveFileLookup", True).parquet(inbox)
    follow_against(
        stream, lambda: fx.b1_target(spark, sf_dir, 1), store, "s1", scratch(spark, "progress"), prepare, every=None, keys=KEYS,
        data_type="master", similar=False,
    ).awaitTermination()
    return ct.series_timeline(store.versions(), "s1").select(F.lit(1).alias("version"), "added", "deleted", "updated", "format_issues")


@query("C2_end_to_end", fx.B1 + "SELECT status, count(*) AS n FROM rows GROUP BY 1")
def c2_end_to_end(spark, sf_dir):
    """Differently named columns, no key given: clean, align, choose key and mode, compare."""
    source = fx.b1_source(spark, sf_dir).withColumnRenamed("order_no", "Order No")
    target = fx.b1_target(spark, sf_dir).withColumnRenamed("order_no", "order_no").withColumnRenamed("amount", "AMOUNT")
    result = compare(source, target, data_type="master", similar=False)
    return result.rows.groupBy("status").agg(F.count("*").alias("n"))
