"""Metrics over the version catalogue: one row per run and summaries over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def run_metrics(versions: DataFrame) -> DataFrame:
    """Rates and quality score of every compared version, with the change of the score against the version before."""
    compared = versions.where("compared_against_version is not null")
    total = F.greatest("source_records", "target_records")
    issues = F.col("updated") + F.col("added") + F.col("deleted") + F.col("renamed") + F.col("format_issues")
    matched = F.greatest(total - issues, F.lit(0))

    def rate(part: Column, whole: Column) -> Column:
        return F.coalesce(part / F.nullif(whole, F.lit(0)) * 100.0, F.lit(0.0))

    out = compared.withColumn("total", total).withColumn("matched", matched)
    out = (
        out.withColumn("match_rate", rate(F.col("matched"), F.col("total")))
        .withColumn("duplicate_rate", rate(F.col("duplicates"), F.col("target_records")))
        .withColumn("missing_rate", rate(F.col("deleted"), F.col("total")))
    )
    raw = F.col("match_rate") - F.col("duplicate_rate") * 0.5 - F.col("missing_rate") * 0.3
    quality = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))
    before = F.lag("quality_score").over(Window.partitionBy("series_id").orderBy("version"))
    return out.withColumn("quality_score", quality).withColumn("quality_delta", F.col("quality_score") - before).select(
        "series_id", "version", "total", "matched", "updated", F.col("added").alias("inserted"), F.col("deleted").alias("missing"),
        "duplicates", "match_rate", "duplicate_rate", "missing_rate", "quality_score", "quality_delta",
    )


def range_comparison(metrics: DataFrame, low: int, high: int) -> DataFrame:
    """Means, totals and first-to-last changes of the runs between two versions, per series."""
    low, high = min(low, high), max(low, high)
    picked = metrics.where(F.col("version").between(low, high))

    def change(name: str) -> Column:
        return F.max_by(name, "version") - F.min_by(name, "version")

    return picked.groupBy("series_id").agg(
        F.count("*").alias("runs"), F.avg("match_rate").alias("avg_match_rate"), F.avg("duplicate_rate").alias("avg_duplicate_rate"),
        F.avg("quality_score").alias("avg_quality_score"), F.sum("matched").alias("matched"), F.sum("updated").alias("updated"),
        F.sum("inserted").alias("inserted"), F.sum("missing").alias("missing"), F.sum("duplicates").alias("duplicates"),
        change("match_rate").alias("match_rate_change"), change("quality_score").alias("quality_score_change"),
    )


def run_points(versions: DataFrame) -> DataFrame:
    """One point per compared version, numbered over all series (R1, R2, …). The catalogue holds one row per run."""
    order = Window.orderBy("created_at", "series_id", "version")
    points = versions.where("version > 0").withColumn("run_no", F.row_number().over(order))
    return points.select(
        "run_no", F.concat(F.lit("R"), F.col("run_no").cast("string")).alias("run_id"), "series_id", "version",
        F.col("name").alias("label"), F.col("filename").alias("target_file"), "updated", F.col("added").alias("inserted"),
        F.col("deleted").alias("missing"),
    )


def run_totals(points: DataFrame) -> DataFrame:
    """Sums over the runs and the largest single count (10 at least), which scales a chart."""
    return points.agg(
        F.coalesce(F.sum("updated"), F.lit(0)).alias("updated"), F.coalesce(F.sum("inserted"), F.lit(0)).alias("inserted"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"), F.count("*").alias("runs"),
        F.greatest(F.lit(10), F.max(F.greatest("updated", "inserted", "missing"))).alias("largest"),
    )


def activity(versions: DataFrame, as_of: str) -> DataFrame:
    """One row: files, comparisons, reports, and uploads or reports in the seven days up to `as_of`."""
    recent = F.col("uploaded_at") > F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 7 DAYS")
    seen = recent & (F.col("uploaded_at") <= F.lit(as_of).cast("timestamp"))
    event = (F.col("version") == 0).cast("int") + F.col("report_file").isNotNull().cast("int")
    return versions.agg(
        F.count("*").alias("files"), F.count_distinct("series_id").alias("comparisons"), F.count("report_file").alias("reports"),
        F.coalesce(F.sum(F.when(seen, event)), F.lit(0)).alias("last_week"),
    )


def recent_events(versions: DataFrame, n: int = 6) -> DataFrame:
    """Latest baseline uploads and reports."""
    uploads = versions.where("version = 0").select(F.col("filename").alias("name"), F.col("uploaded_at").alias("at"), F.lit("Dataset upload").alias("kind"))
    reports = versions.where("report_file is not null").select(F.col("report_file").alias("name"), F.col("uploaded_at").alias("at"), F.lit("Report generated").alias("kind"))
    return uploads.unionByName(reports).orderBy(F.desc("at"), "name").limit(n)


def largest_series(versions: DataFrame, n: int = 5) -> DataFrame:
    """Series with most files."""
    return versions.groupBy("series_id").agg(F.max("name").alias("name"), F.count("*").alias("files")).orderBy(F.desc("files"), "series_id").limit(n)


def progression(versions: DataFrame) -> DataFrame:
    """Per series and day: is it the source, and how much changed."""
    return versions.select(
        "series_id", F.col("version").alias("day"), "uploaded_at", (F.col("version") == 0).alias("is_source"),
        F.col("added").alias("added_count"), F.col("deleted").alias("deleted_count"), F.col("updated").alias("updated_count"),
        (F.col("added") + F.col("deleted") + F.col("updated")).alias("total_changes"),
    )


def previous_versions(versions: DataFrame) -> DataFrame:
    """Every version with the one before it in its series."""
    chain = Window.partitionBy("series_id").orderBy("version")
    return versions.select(
        "series_id", "version", "label", F.lag("version").over(chain).alias("previous_version"), F.lag("label").over(chain).alias("previous_label")
    )
