"""Comparisons of arriving tables: each micro-batch is compared and appended as a version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tablematch.config import DEFAULTS, Settings
from tablematch.operators.align import align
from tablematch.operators.clean import add_missing_keys, data_columns, normalize
from tablematch.operators.days import day_summary
from tablematch.operators.insights import bucket_counts
from tablematch.operators.lines import compare_lines
from tablematch.operators.master import Comparison, compare_master
from tablematch.operators.profile import detect_date_column, guess_key_columns, resolve_data_type
from tablematch.operators.report import sheets, write_sheets
from tablematch.operators.rowpairs import compare_row_pairs, pair_errors, pair_summary
from tablematch.plans.skew import durable
from tablematch.sources.catalog import VersionStore


def compare(
    source: DataFrame, target: DataFrame, keys: list[str] | None = None, data_type: str = "auto",
    mapping: dict[str, str] | None = None, similar: bool = True, settings: Settings = DEFAULTS,
) -> Comparison:
    """Compare two tables with ordinals: clean, align the columns, choose keys and mode, compare."""
    source, target = normalize(source), normalize(target)
    target = align(source, target, mapping, settings)
    keys = keys or guess_key_columns(source, target, settings)
    source, target = add_missing_keys(source, target, keys)
    mode = resolve_data_type(data_type, source, target, keys, settings)
    date = detect_date_column(source, target, settings)
    if mode == "transactional":
        return compare_lines(source, target, keys, date, settings)
    return compare_master(source, target, keys, date, similar, settings)


def compare_rows(source: DataFrame, target: DataFrame, pairs: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Row-index mode: two tables with ordinals by given row pairs (source_rid, target_rid), as a saved profile holds them
    (`row_pairs`). Returns the compared pairs and the summary; pairs that cannot be are an error that tells the first ones."""
    source, target = normalize(source), normalize(target)
    if pairs.isEmpty():
        raise ValueError("no row pairs are given")
    wrong = pair_errors(pairs, source, target).orderBy("source_rid", "target_rid", "error").limit(10).collect()
    if wrong:
        raise ValueError("; ".join(f"{r.source_rid}, {r.target_rid}: {r.error}" for r in wrong))
    compared = durable(compare_row_pairs(source, target, pairs, settings))
    return compared, pair_summary(source, target, pairs, compared)


def store_version(
    store: VersionStore, series_id: str, df: DataFrame, filename: str, at, keys: list[str] | None = None, data_type: str = "auto",
    label: str | None = None, mapping: dict[str, str] | None = None, batch_id: int | None = None, name: str | None = None,
    against: DataFrame | None = None, similar: bool = True, settings: Settings = DEFAULTS, arrival: str | None = None,
    report: bool = False,
) -> int:
    """Append a table as the next version of its series and return its number.

    Version 0 is the baseline. A later version is compared with its predecessor (or with `against`); rows, diff,
    snapshots and the catalogue row are written, the catalogue row last. A stream batch that runs again finds its
    number by `batch_id` and `arrival` and rewrites the same partitions. With `report` the sheets are written too, and
    the catalogue row names them.
    """
    again = store.of_batch(series_id, batch_id, arrival) if batch_id is not None else None
    before = store.latest(series_id)
    if again is not None:
        version = again["version"]
        before = None if version == 0 else next(
            iter(store.versions().where((F.col("series_id") == series_id) & (F.col("version") == version - 1)).collect()), None
        )
    else:
        version = 0 if before is None else before["version"] + 1
    new = durable(normalize(df))
    entry = {
        "series_id": series_id, "version": version, "name": name or (before["name"] if before else filename),
        "label": label or ("Source" if version == 0 else f"Day {version}"), "filename": filename,
        "created_at": before["created_at"] if before else at, "uploaded_at": at, "row_count": new.count(),
        "column_count": len(data_columns(new)), "data_type": data_type, "batch_id": batch_id, "key_columns": keys,
        "arrival": arrival,
    }
    if before is None and against is None:
        store.write_data(new, series_id, version)
        store.add(entry)
        return version
    old = normalize(against) if against is not None else store.read(series_id, before["version"])
    keys = keys or (list(before["key_columns"]) if before and before["key_columns"] else None)
    result = compare(old, new, keys, data_type, mapping, similar, settings)
    result.rows = durable(result.rows)
    counts = bucket_counts(result).first()
    # the compared target carries the aligned column names, which the next version will be compared with
    store.write_data(result.target, series_id, version)
    store.write_diff(result.rows, result.layout, series_id, version)
    rekeyed = before is not None and list(before["key_columns"] or []) != result.layout.keys
    if against is None and (version == 1 or rekeyed):
        # the predecessor's snapshot is missing (baseline) or was keyed otherwise
        store.write_snapshot(result.source, result.layout.keys, series_id, version - 1)
    store.write_snapshot(result.target, result.layout.keys, series_id, version)
    if against is None:
        store.write_changes(series_id, version)
    named = f"{series_id}_v{version}" if report else None
    if named:
        labels = before["label"] if before else "Source", entry["label"]
        write_sheets(sheets(result, day_summary(result, str(at)[:10]), *labels), store.report_path(named))
    entry.update(
        key_columns=result.layout.keys, data_type=result.data_type, added=counts["missing_in_source"],
        deleted=counts["missing_in_target"], updated=counts["mismatches"], renamed=counts["fuzzy_matches"],
        duplicates=counts["duplicates_source"] + counts["duplicates_target"], format_issues=counts["format_inconsistencies"],
        source_records=counts["source_record_count"], target_records=counts["target_record_count"],
        compared_against_version=before["version"] if before else None, compared_against_label=before["label"] if before else "Source",
        report_file=named,
    )
    store.add(entry)
    return version


def follow(
    arrivals: DataFrame, store: VersionStore, series_id: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    every: str | None = None, arrival: str | None = None, arrived_at: str = "uploaded_at", **options,
) -> StreamingQuery:
    """Version chain over a stream: each micro-batch becomes a version compared with the one before. Where a micro-batch
    can hold several arrivals, `arrival` names the column that tells them apart: each becomes a version of its own, in
    order of `arrived_at`. Without `every` the query handles what is there and stops."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        if arrival is not None:
            # one row per arrival, as in the catalogue
            name = F.coalesce(F.col(arrival).cast("string"), F.lit(""))
            parts = batch.groupBy(name.alias("name")).agg(F.min(arrived_at).alias("at")).orderBy("at", "name").collect()
            for part in parts:
                rows = prepare(batch.where(name == part["name"]))
                store_version(store, series_id, rows, part["name"], part["at"], batch_id=batch_id, arrival=part["name"], **options)
            return
        at = batch.sparkSession.sql("SELECT current_timestamp() AS t").first()["t"]
        store_version(store, series_id, prepare(batch), f"batch-{batch_id}", at, batch_id=batch_id, **options)

    writer = arrivals.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def follow_against(
    arrivals: DataFrame, target: Callable[[], DataFrame], store: VersionStore, series_id: str, checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df, every: str | None = "10 minutes", **options,
) -> StreamingQuery:
    """Periodic comparison: each newly staged table against the target as it is at that moment."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        at = batch.sparkSession.sql("SELECT current_timestamp() AS t").first()["t"]
        store_version(
            store, series_id, target(), f"batch-{batch_id}", at, batch_id=batch_id, against=prepare(batch), **options
        )

    writer = arrivals.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()
