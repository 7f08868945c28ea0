"""Differences by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablematch.functions.values import day_of
from tablematch.operators.cells import date_text, has_kind
from tablematch.operators.master import Comparison

METRICS = [
    "source_records", "target_records", "missing_in_target", "missing_in_source", "duplicates_source",
    "duplicates_target", "mismatches", "format_inconsistencies",
]
ISSUES = METRICS[2:]


def drop_future(days: DataFrame, as_of: str) -> DataFrame:
    """Days up to `as_of`; rows without a usable date stay."""
    return days.where((F.col("day") == "Undated") | (F.col("day") <= as_of))


def day_counts(comparison: Comparison) -> DataFrame:
    """Counts per day, possibly several rows per day. Every table is counted in one pass by the date text as it
    stands, so that only distinct texts are parsed."""
    date = comparison.layout.date

    def of_table(df: DataFrame, metric: str) -> DataFrame:
        return df.groupBy(F.col(f"`{date}`").alias("text")).agg(F.count("*").alias(metric))

    status, paired = F.col("status"), F.col("confidence").isNull()
    out = comparison.rows.groupBy(date_text(comparison.layout).alias("text")).agg(
        F.count_if(status == "Deleted").alias("missing_in_target"),
        F.count_if(status == "Added").alias("missing_in_source"),
        F.count_if(paired & has_kind("value")).alias("mismatches"),
        F.count_if(paired & has_kind("format")).alias("format_inconsistencies"),
    )
    parts = [(comparison.source, "source_records"), (comparison.target, "target_records")]
    if comparison.duplicates_source is not None:
        parts += [(comparison.duplicates_source, "duplicates_source"), (comparison.duplicates_target, "duplicates_target")]
    for df, metric in parts:
        if date in df.columns:
            out = out.unionByName(of_table(df, metric), allowMissingColumns=True)
    per_text = out.groupBy("text").agg(*[F.sum(m).alias(m) for m in out.columns if m != "text"])
    return per_text.select(day_of(F.col("text")).alias("day"), *per_text.columns[1:])


def day_summary(comparison: Comparison, as_of: str) -> DataFrame:
    """One row per day with records and issues of both sides; empty without a date column."""
    if not comparison.layout.date:
        spark = comparison.rows.sparkSession
        return spark.createDataFrame([], "day string, " + ", ".join(f"{m} long" for m in METRICS))
    counts = day_counts(comparison)
    sums = [
        (F.coalesce(F.sum(m), F.lit(0)) if m in counts.columns else F.lit(0)).cast("long").alias(m) for m in METRICS
    ]
    return drop_future(counts.groupBy("day").agg(*sums), as_of)


def _issue_total():
    total = F.lit(0)
    for m in ISSUES:
        total = total + F.col(m)
    return total.cast("long")


def timeline(days: DataFrame) -> DataFrame:
    """Dated days with the counts that a chart shows."""
    return days.where("day <> 'Undated'").select(
        "day",
        F.col("missing_in_source").alias("added"),
        F.col("missing_in_target").alias("deleted"),
        (F.col("duplicates_source") + F.col("duplicates_target")).alias("duplicates"),
        F.col("mismatches").alias("value_changes"),
        F.col("format_inconsistencies").alias("format_issues"),
        _issue_total().alias("total"),
    )


def busiest_day(days: DataFrame) -> DataFrame:
    """One row: the first of the days with most issues (null when there are none) and whether undated rows exist."""
    dated = F.when((F.col("day") != "Undated") & (_issue_total() > 0), F.struct(_issue_total().alias("n"), -F.datediff(F.col("day").try_cast("date"), F.lit("1970-01-01").cast("date")), F.col("day")))
    return days.agg(F.max(dated)["day"].alias("busiest_day"), F.coalesce(F.max(F.col("day") == "Undated"), F.lit(False)).alias("has_undated"))
