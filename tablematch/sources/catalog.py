"""Stores on a shared folder: staged uploads, versions of a series, diffs, snapshots, mapping profiles.

Every write replaces exactly the partitions of one batch, version or profile, so a repeated write after a failure
leaves the same table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from tablematch.operators.cells import Layout, as_records
from tablematch.operators.clean import data_columns
from tablematch.operators.history import CHANGE_SCHEMA, changes_between, snapshot

VERSION_SCHEMA = """series_id string, version int, name string, label string, filename string, created_at timestamp,
    uploaded_at timestamp, row_count long, column_count int, key_columns array<string>, data_type string, added long,
    deleted long, updated long, renamed long, duplicates long, format_issues long, source_records long,
    target_records long, compared_against_version int, compared_against_label string, report_file string, batch_id long,
    arrival string"""
PROFILE_SCHEMA = """profile_id string, version int, mode string, source_column string, target_column string,
    confidence double, is_key boolean, source_index long, target_index long"""
STAGED_SCHEMA = """batch_id string, project_name string, entity_name string, business_key string, uploaded_at timestamp,
    row_data string"""
SNAPSHOT_SCHEMA = "series_id string, version int, row_key string, row_data map<string,string>"


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored table, or an empty one before the first write."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    exists = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


# ---- staging ------------------------------------------------------------------------------------------------------


def stage_rows(
    df: DataFrame, path: str, project: str, entity: str, business_key: str, batch_id: str, uploaded_at: Column | None = None
) -> None:
    """Store rows of any shape as JSON records of one batch."""
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in data_columns(df)]))
    rows = df.select(
        F.lit(batch_id).alias("batch_id"), F.lit(project).alias("project_name"), F.lit(entity).alias("entity_name"),
        F.lit(business_key).alias("business_key"), (F.current_timestamp() if uploaded_at is None else uploaded_at).alias("uploaded_at"),
        record.alias("row_data"),
    )
    replace_partitions(rows, path, "batch_id")


def staged(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, STAGED_SCHEMA)


# ---- mapping profiles ---------------------------------------------------------------------------------------------


def save_profile(spark: SparkSession, path: str, profile_id: str, mode: str, items: list[dict]) -> int:
    """Save the column or row pairs of a mapping under a name; saving again adds the next version."""
    if mode not in ("HEADER_COLUMN", "ROW_INDEX"):
        raise ValueError("mode must be HEADER_COLUMN or ROW_INDEX")
    stored = _read(spark, path, PROFILE_SCHEMA).where(F.col("profile_id") == profile_id)
    version = (stored.agg(F.max("version").alias("v")).first()["v"] or 0) + 1
    rows = [
        (
            profile_id, version, mode, i.get("source_column"), i.get("target_column"), float(i.get("confidence", 1.0)),
            bool(i.get("is_key", False)), i.get("source_index"), i.get("target_index"),
        )
        for i in items
    ]
    replace_partitions(spark.createDataFrame(rows, PROFILE_SCHEMA), path, "profile_id", "version")
    return version


def save_row_pairs(pairs: DataFrame, path: str, profile_id: str) -> int:
    """Save row pairs (source_rid, target_rid) of any number under a name; saving again adds the next version."""
    stored = _read(pairs.sparkSession, path, PROFILE_SCHEMA).where(F.col("profile_id") == profile_id)
    version = (stored.agg(F.max("version").alias("v")).first()["v"] or 0) + 1
    none = F.lit(None)
    rows = pairs.select(
        F.lit(profile_id).alias("profile_id"), F.lit(version).alias("version"), F.lit("ROW_INDEX").alias("mode"), none.cast("string").alias("source_column"),
        none.cast("string").alias("target_column"), F.lit(1.0).alias("confidence"), F.lit(False).alias("is_key"),
        F.col("source_rid").cast("long").alias("source_index"), F.col("target_rid").cast("long").alias("target_index"),
    )
    replace_partitions(rows, path, "profile_id", "version")
    return version


def row_pairs(profile: DataFrame) -> DataFrame:
    """(source_rid, target_rid) of a loaded profile of row pairs."""
    return profile.where("mode = 'ROW_INDEX'").select(F.col("source_index").alias("source_rid"), F.col("target_index").alias("target_rid"))


def load_profile(spark: SparkSession, path: str, profile_id: str) -> DataFrame:
    """Latest version of a mapping."""
    mine = _read(spark, path, PROFILE_SCHEMA).where(F.col("profile_id") == profile_id)
    return mine.where(F.col("version") == mine.agg(F.max("version")).scalar())


# ---- series -------------------------------------------------------------------------------------------------------


@dataclass
class VersionStore:
    """Series of versions under one folder: `versions` (catalogue), `data`, `diffs`, `snapshots`."""

    spark: SparkSession
    root: str

    def versions(self) -> DataFrame:
        return _read(self.spark, f"{self.root}/versions", VERSION_SCHEMA)

    def latest(self, series_id: str) -> Row | None:
        """Catalogue row of the newest version of a series."""
        rows = self.versions().where(F.col("series_id") == series_id).orderBy(F.desc("version")).limit(1).collect()
        return rows[0] if rows else None

    def of_batch(self, series_id: str, batch_id: int, arrival: str | None = None) -> Row | None:
        """Catalogue row written by a stream batch (for one of its arrivals), if that batch ran before."""
        mine = (F.col("series_id") == series_id) & (F.col("batch_id") == batch_id) & F.col("arrival").eqNullSafe(F.lit(arrival))
        rows = self.versions().where(mine).limit(1).collect()
        return rows[0] if rows else None

    def data_path(self, series_id: str, version: int) -> str:
        return f"{self.root}/data/{series_id}/version={version}"

    def read(self, series_id: str, version: int) -> DataFrame:
        """Stored rows of one version; nulls as ''."""
        df = self.spark.read.parquet(self.data_path(series_id, version))
        return df.select(*[F.col(c) if c == "_rid" else F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns])

    def write_data(self, df: DataFrame, series_id: str, version: int) -> None:
        df.write.mode("overwrite").parquet(self.data_path(series_id, version))

    def add(self, entry: dict) -> None:
        """Write the catalogue row of one version."""
        names = [f.name for f in self.spark.createDataFrame([], VERSION_SCHEMA).schema]
        row = self.spark.createDataFrame([tuple(entry.get(n) for n in names)], VERSION_SCHEMA)
        replace_partitions(row, f"{self.root}/versions", "series_id", "version")

    def write_diff(self, rows: DataFrame, layout: Layout, series_id: str, version: int) -> None:
        records = as_records(rows, layout).withColumn("series_id", F.lit(series_id)).withColumn("version", F.lit(version))
        path = f"{self.root}/diffs/series_id={series_id}/version={version}"
        records.drop("series_id", "version").write.mode("overwrite").partitionBy("status").parquet(path)

    def read_diff(self, series_id: str, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/diffs/series_id={series_id}/version={version}")

    def write_snapshot(self, df: DataFrame, keys: list[str], series_id: str, version: int) -> None:
        replace_partitions(snapshot(df, keys, series_id, version), f"{self.root}/snapshots", "series_id", "version")

    def report_path(self, name: str) -> str:
        return f"{self.root}/reports/{name}"

    def read_sheet(self, name: str, sheet: str) -> DataFrame:
        """One sheet of a stored report, by the report's name in the catalogue (`report_file`)."""
        return self.spark.read.parquet(f"{self.report_path(name)}/{sheet}")

    def write_changes(self, series_id: str, version: int) -> None:
        """Store which cells of the snapshot of `version` differ from the one before, as a run of its own."""
        mine = self.snapshots().where(F.col("series_id") == series_id)
        changes = changes_between(mine.where(F.col("version") == version - 1), mine.where(F.col("version") == version))
        changes.drop("series_id").write.mode("overwrite").parquet(f"{self._runs(series_id)}/first={version}/last={version}")

    def _runs(self, series_id: str) -> str:
        return f"{self.root}/changes/series_id={series_id}"

    def runs(self, series_id: str) -> list[tuple[int, int]]:
        """(first, last) version of the runs that hold the changes of a series: the longest from each version on."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._runs(series_id))
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [f.getPath() for f in files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(path, "first=*/last=*/_SUCCESS")) or []]
        spans = {}
        for p in found:
            first, last = (int(x.getName().partition("=")[2]) for x in (p.getParent().getParent(), p.getParent()))
            spans[first] = max(last, spans.get(first, last))
        out, at = [], 0
        for first in sorted(spans):
            if first > at:
                out.append((first, spans[first]))
                at = spans[first]
        return out

    def changes(self, series_id: str, up_to: int | None = None) -> DataFrame:
        """The stored changes of a series; only its runs are read, whatever the number of its rows."""
        paths = [f"{self._runs(series_id)}/first={a}/last={b}" for a, b in self.runs(series_id) if up_to is None or a <= up_to]
        if not paths:
            return self.spark.createDataFrame([], CHANGE_SCHEMA)
        fields = CHANGE_SCHEMA.replace("series_id string, ", "")
        rows = self.spark.read.schema(fields).parquet(*paths).select(F.lit(series_id).alias("series_id"), "*")
        return rows if up_to is None else rows.where(F.col("version") <= up_to)

    def compact_changes(self, series_id: str) -> None:
        """Write the runs of a series as one, in order of row and column. It counts as soon as it is whole; the runs it is
        made of stay behind it and are not read any more."""
        runs = self.runs(series_id)
        if len(runs) > 1:
            rows = self.changes(series_id).drop("series_id").repartitionByRange("row_key", "column_name").sortWithinPartitions("row_key", "column_name", "version")
            rows.write.mode("overwrite").parquet(f"{self._runs(series_id)}/first={runs[0][0]}/last={runs[-1][1]}")

    def snapshots(self) -> DataFrame:
        return _read(self.spark, f"{self.root}/snapshots", SNAPSHOT_SCHEMA)


def list_series(versions: DataFrame) -> DataFrame:
    """One row per series: name, number of versions, first and latest version."""
    return versions.groupBy("series_id").agg(
        F.max("name").alias("name"), F.min("created_at").alias("created_at"), F.max_by("data_type", "version").alias("data_type"),
        F.count("*").alias("version_count"), F.greatest(F.count("*") - 1, F.lit(0)).alias("target_count"),
        F.min_by("filename", "version").alias("baseline_file"), F.max("version").alias("latest_version"),
        F.max_by("label", "version").alias("latest_label"),
    )


def series_timeline(versions: DataFrame, series_id: str) -> DataFrame:
    """Versions of a series with their change counts, 0 for the baseline."""
    counts = ["added", "deleted", "updated", "renamed", "format_issues"]
    return versions.where(F.col("series_id") == series_id).select(
        "version", "label", "uploaded_at", "row_count", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts]
    )
