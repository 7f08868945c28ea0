"""Cell-by-cell comparison of paired rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tablematch.functions.values import canonical, day_of

DIFF_TYPE = "array<struct<column:string,source_value:string,target_value:string,kind:string>>"


@dataclass
class Layout:
    """Columns of a comparison."""

    keys: list[str]
    compare: list[str]
    source: list[str]
    target: list[str]
    date: str | None = None

    @property
    def source_only(self) -> list[str]:
        return [c for c in self.source if c not in self.target]

    @property
    def target_only(self) -> list[str]:
        return [c for c in self.target if c not in self.source]


def layout_of(source: list[str], target: list[str], keys: list[str], date: str | None = None) -> Layout:
    common = [c for c in source if c in target and c not in keys]
    return Layout(list(keys), common, list(source), list(target), date)


def cell_kind(left: Column, right: Column) -> Column:
    """null when the trimmed texts agree, 'format' when only the canonical values do, else 'value'. The canonical
    forms are computed only for cells whose texts differ."""
    return (
        F.when(F.trim(left) == F.trim(right), F.lit(None).cast("string"))
        .when(canonical(left) == canonical(right), F.lit("format"))
        .otherwise(F.lit("value"))
    )


def compare_pairs(pairs: DataFrame, layout: Layout) -> DataFrame:
    """Add `status`, `diffs` and `row_date` to pairs given as structs `src` and `tgt`; one of them may be null.

    Whether all texts agree is plain generated code. Only rows with a differing text go through the cell array, whose
    one lambda serves all columns.
    """
    left = {c: F.col("src").getField(c) for c in layout.compare}
    right = {c: F.col("tgt").getField(c) for c in layout.compare}
    both = F.col("src").isNotNull() & F.col("tgt").isNotNull()
    differs = F.lit(False)
    for c in layout.compare:
        differs = differs | (left[c] != right[c])
    nothing = F.array().cast(DIFF_TYPE)
    cells = [
        F.struct(F.lit(c).alias("column"), left[c].alias("source_value"), right[c].alias("target_value"))
        for c in layout.compare
    ]

    def judged(x: Column) -> Column:
        return F.struct(
            x["column"].alias("column"), x["source_value"].alias("source_value"), x["target_value"].alias("target_value"),
            cell_kind(x["source_value"], x["target_value"]).alias("kind"),
        )

    found = nothing
    if cells:
        differing = F.filter(F.array(*cells), lambda x: x["source_value"] != x["target_value"])
        found = F.when(both & differs, F.filter(F.transform(differing, judged), lambda x: x["kind"].isNotNull())).otherwise(nothing)
    compared = pairs.withColumn("diffs", found.cast(DIFF_TYPE))
    status = (
        F.when(F.col("tgt").isNull(), "Deleted")
        .when(F.col("src").isNull(), "Added")
        .when(F.size("diffs") == 0, "Matched")
        .when(has_kind("value"), "Updated")
        .otherwise("Format Only")
    )
    return compared.select(*pairs.columns, status.alias("status"), "diffs", row_date(layout).alias("row_date"))


def date_text(layout: Layout) -> Column:
    """Date cell of the row as it stands: the source side's, the target's for rows without a source."""
    sides = [F.col(side).getField(layout.date) for side, names in (("src", layout.source), ("tgt", layout.target)) if layout.date in names]
    return F.coalesce(*sides)


def row_date(layout: Layout) -> Column:
    """Day of the row."""
    return day_of(date_text(layout)) if layout.date else F.lit("Undated")


def diffs_of(kind: str, diffs: str | Column = "diffs") -> Column:
    return F.filter(F.col(diffs) if isinstance(diffs, str) else diffs, lambda d: d["kind"] == kind)


def has_kind(kind: str) -> Column:
    return F.exists("diffs", lambda d: d["kind"] == kind)


def changed_columns() -> Column:
    """Names of the changed columns: value changes first, then format-only ones."""
    return F.concat(
        F.transform(diffs_of("value"), lambda d: d["column"]), F.transform(diffs_of("format"), lambda d: d["column"])
    )


def as_records(rows: DataFrame, layout: Layout) -> DataFrame:
    """Comparison rows with generic maps in place of the typed structs, for stores that hold many layouts."""

    def as_map(side: str, names: list[str]) -> Column:
        pairs = [x for c in names for x in (F.lit(c), F.col(side).getField(c))]
        empty = F.create_map().cast("map<string,string>")
        return F.when(F.col(side).isNull(), empty).otherwise(F.create_map(*pairs).cast("map<string,string>"))

    return rows.select(
        F.create_map(*[x for k in layout.keys for x in (F.lit(k), F.col(k))]).alias("key"),
        "status",
        changed_columns().alias("changed_columns"),
        "diffs",
        as_map("src", layout.source).alias("source_row"),
        as_map("tgt", layout.target).alias("target_row"),
        "row_date",
        "confidence",
    )
