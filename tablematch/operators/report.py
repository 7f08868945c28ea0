"""Report tables: one DataFrame per sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablematch.functions.values import lenient_amount, signed_difference
from tablematch.operators.align import amount_like, schema_difference
from tablematch.operators.cells import Layout, changed_columns, diffs_of, has_kind
from tablematch.operators.insights import bucket_counts
from tablematch.operators.master import Comparison


def _cell(side: str, name: str) -> Column:
    return F.coalesce(F.col(side).getField(name), F.lit(""))


def _own_name(name: str) -> str:
    """Name of a data column beside the sheet's Status column; Spark does not tell names apart by case."""
    return f"{name} (data)" if name.lower() == "status" else name


def amount_columns(layout: Layout, source: str | None = None, target: str | None = None) -> tuple[str | None, str | None]:
    """Amount columns of both sides: the given ones, else the first whose name sounds like money."""
    s = source if source in layout.source else amount_like(layout.source, report=True)
    t = target if target in layout.target else amount_like(layout.target, report=True) or s
    return s, t


def side_by_side(
    rows: DataFrame, layout: Layout, before: str = "Source", after: str = "Target", amount_source: str | None = None,
    amount_target: str | None = None,
) -> DataFrame:
    """Every record of both tables: status, key, both values of each common column, one-sided columns, amount gap."""
    cells = [F.col("status").alias("Status"), *[F.col(k).alias(_own_name(k)) for k in layout.keys]]
    for c in layout.compare:
        cells += [_cell("src", c).alias(f"{before} — {c}"), _cell("tgt", c).alias(f"{after} — {c}")]
    cells += [_cell("src", c).alias(f"{before} only — {c}") for c in layout.source_only]
    cells += [_cell("tgt", c).alias(f"{after} only — {c}") for c in layout.target_only]
    s, t = amount_columns(layout, amount_source, amount_target)
    if s and t and s in layout.source and t in layout.target:
        gap = signed_difference(
            lenient_amount(F.col("src").getField(s)), lenient_amount(F.col("tgt").getField(t)),
            F.col("src").isNotNull(), F.col("tgt").isNotNull(),
        )
        cells.append(F.round(gap, 2).alias("Amount Difference (Source − Target)"))
    return rows.select(*cells)


def flat_sheet(df: DataFrame, status: str) -> DataFrame:
    """Rows of one side under a status text; a data column named Status gives way."""
    names = [c for c in df.columns if c not in ("_rid", "Status")]
    return df.select(F.lit(status).alias("Status"), *[F.col(f"`{c}`").alias(_own_name(c)) for c in names])


def deleted_sheet(comparison: Comparison, before: str = "Source", after: str = "Target") -> DataFrame:
    rows = comparison.rows.where("status = 'Deleted'").select("src.*")
    return flat_sheet(rows, f"Deleted — in '{before}', missing from '{after}'")


def added_sheet(comparison: Comparison, before: str = "Source", after: str = "Target") -> DataFrame:
    rows = comparison.rows.where("status = 'Added'").select("tgt.*")
    return flat_sheet(rows, f"Added — new in '{after}', not in '{before}'")


def duplicate_sheet(df: DataFrame, label: str) -> DataFrame:
    return flat_sheet(df, f"Duplicate key in '{label}'")


def columns_changed(rows: DataFrame, layout: Layout) -> list[str]:
    """Compared columns that changed in any of the rows, in table order; bounded by the schema."""
    found = {r["c"] for r in rows.select(F.explode(changed_columns()).alias("c")).distinct().collect()}
    return [c for c in layout.compare if c in found]


def _before_after(rows: DataFrame, layout: Layout, before: str, after: str, first: list[Column], changed: list[str]) -> DataFrame:
    pairs = [x for c in changed for x in (_cell("src", c).alias(f"{before} ← {c}"), _cell("tgt", c).alias(f"{after} → {c}"))]
    same = [_cell("src", c).alias(_own_name(c)) for c in layout.source if c not in layout.keys and c not in changed]
    return rows.select(*first, *pairs, *same)


def issue_sheet(comparison: Comparison, kind: str = "value", before: str = "Source", after: str = "Target") -> DataFrame:
    """Updated (kind 'value') or format-only (kind 'format') records: both values of the columns that changed in any
    of them, the other columns once."""
    layout = comparison.layout
    rows = comparison.rows.where(F.col("confidence").isNull() & has_kind(kind)).withColumn("diffs", diffs_of(kind))
    names = F.array_join(F.transform("diffs", lambda d: d["column"]), ", ")
    first = [F.lit("Updated").alias("Status"), *[F.col(k).alias(_own_name(k)) for k in layout.keys], names.alias("Changed Columns")]
    return _before_after(rows, layout, before, after, first, columns_changed(rows, layout))


def renamed_sheet(comparison: Comparison, before: str = "Source", after: str = "Target") -> DataFrame:
    """Renamed records: key before and after, confidence, changed columns."""
    layout = comparison.layout
    rows = comparison.rows.where("status = 'Renamed'")
    names = F.array_join(changed_columns(), ", ")
    first = [F.col("status").alias("Status"), F.col("confidence").alias("Match Confidence")]
    for k in layout.keys:
        first += [_cell("src", k).alias(f"Key Before ({k})"), _cell("tgt", k).alias(f"Key After ({k})")]
    first.append(F.when(names == "", "(key only)").otherwise(names).alias("Changed Columns"))
    return _before_after(rows, layout, before, after, first, columns_changed(rows, layout))


def totals(comparison: Comparison, source: str | None = None, target: str | None = None) -> DataFrame | None:
    """Amount totals over the compared rows of both sides, unreadable amounts as 0."""
    s, t = amount_columns(comparison.layout, source, target)
    if not s or not t or t not in comparison.layout.target:
        return None

    def total(side: str, name: str) -> Column:
        return F.sum(F.when(F.col(side).isNotNull(), lenient_amount(F.col(side).getField(name)))).cast("decimal(28,2)")

    return comparison.rows.agg(total("src", s).alias("source_total"), total("tgt", t).alias("target_total"))


def summary_sheet(comparison: Comparison, before: str = "Source", after: str = "Target") -> DataFrame:
    """(Metric, Value) rows: sizes, buckets, amount totals."""
    names = {
        "source_record_count": f"Rows in '{before}'", "target_record_count": f"Rows in '{after}'", "matched": "Matched (No Change)",
        "missing_in_target": "Deleted", "missing_in_source": "Added", "mismatches": "Updated (Value Changes)",
        "fuzzy_matches": "Renamed (Fuzzy Matched)", "format_inconsistencies": "Format-Only Differences",
        "duplicates_source": f"Duplicates in '{before}'", "duplicates_target": f"Duplicates in '{after}'",
    }
    counts = bucket_counts(comparison).select(*[F.col(k).cast("decimal(28,2)").alias(v) for k, v in names.items()])
    out = counts.unpivot([], [f"`{v}`" for v in names.values()], "Metric", "Value")
    amounts = totals(comparison)
    if amounts is not None:
        s, t = amount_columns(comparison.layout)
        money = {
            f"Source Income Total ({s})": F.col("source_total"), f"Target Income Total ({t})": F.col("target_total"),
            "Income Amount Difference (Source − Target)": F.coalesce("source_total", F.lit(0)) - F.coalesce("target_total", F.lit(0)),
        }
        wide = amounts.select(*[v.cast("decimal(28,2)").alias(k) for k, v in money.items()])
        out = out.unionByName(wide.unpivot([], [f"`{k}`" for k in money], "Metric", "Value"))
    return out


def sheets(comparison: Comparison, days: DataFrame, before: str = "Source", after: str = "Target") -> dict[str, DataFrame]:
    """All report tables by name. The sheets share one comparison: give it rows that are stored, so that each sheet
    is a scan."""
    layout = comparison.layout
    out = {
        "summary": summary_sheet(comparison, before, after),
        "all_rows": side_by_side(comparison.rows, layout, before, after),
        "deleted": deleted_sheet(comparison, before, after),
        "added": added_sheet(comparison, before, after),
        "updated": issue_sheet(comparison, "value", before, after),
        "format": issue_sheet(comparison, "format", before, after),
        "renamed": renamed_sheet(comparison, before, after),
        "schema": schema_difference(comparison.rows.sparkSession, layout.source, layout.target),
        "day_wise": days,
    }
    if comparison.duplicates_source is not None:
        out["duplicates_source"] = duplicate_sheet(comparison.duplicates_source, before)
        out["duplicates_target"] = duplicate_sheet(comparison.duplicates_target, after)
    return out


def write_sheets(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        safe = df.toDF(*[c.translate(str.maketrans(" ,;{}()\n\t=", "__________")) for c in df.columns])
        safe.write.mode("overwrite").parquet(f"{folder}/{name}")


def grouped_reports(versions: DataFrame) -> DataFrame:
    """Reports per series, in version order; a report without a series is a one-off."""
    series = F.coalesce("series_id", F.lit("one_off"))
    return versions.where("report_file is not null").groupBy(series.alias("group_id")).agg(
        F.coalesce(F.max("name"), F.lit("One-off Comparisons")).alias("title"),
        F.count("*").alias("reports"),
        F.transform(F.sort_array(F.collect_list(F.struct("version", "report_file"))), lambda x: x["report_file"]).alias("files"),
    )
