"""Row snapshots of versions and the history of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablematch.functions.text import key_text
from tablematch.functions.values import canonical, display_value
from tablematch.operators.clean import data_columns
from tablematch.plans.skew import first_rows


def snapshot(df: DataFrame, keys: list[str], series_id: str, version: int) -> DataFrame:
    """(series_id, version, row_key, row_data) of a table: blank keys are left out, the first row per key stays."""
    names = data_columns(df)
    record = F.create_map(*[x for c in names for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])
    keyed = df.select(key_text([F.col(k) for k in keys], " | ").alias("row_key"), record.alias("row_data"), "_rid")
    kept = first_rows(keyed.where(F.trim("row_key") != ""), ["row_key"])
    return kept.select(F.lit(series_id).alias("series_id"), F.lit(version).alias("version"), "row_key", "row_data")


def value_history(snapshots: DataFrame, columns: list[str] | None = None, only_changed: bool = True) -> DataFrame:
    """Per series, row and column the value of each version, `changed` when the canonical values differ. Null values
    are left out; a row that a version lacks is no change. The lists are as long as there are versions."""
    cells = snapshots.select("series_id", "version", "row_key", F.explode("row_data").alias("column_name", "value"))
    if columns:
        cells = cells.where(F.col("column_name").isin(*columns))
    grouped = cells.where("value is not null").groupBy("series_id", "row_key", "column_name").agg(
        F.sort_array(F.collect_list(F.struct("version", "value"))).alias("cells")
    )
    # canonical forms are needed only where the texts differ
    texts = F.transform("cells", lambda x: x["value"])
    differ = F.size(F.array_distinct(F.transform(texts, canonical))) > 1
    grouped = grouped.withColumn("changed", F.when(F.size(F.array_distinct(texts)) == 1, False).otherwise(differ))
    if only_changed:
        grouped = grouped.where("changed")
    shown = F.transform("cells", lambda x: F.struct(x["version"], display_value(x["value"])))
    out = grouped.select("series_id", "row_key", "column_name", F.map_from_entries(shown).alias("values"), "changed")
    return out.withColumn("distinct_values", F.size(F.array_distinct(F.map_values("values"))))


def most_changed_first(history: DataFrame) -> DataFrame:
    return history.orderBy(F.desc("distinct_values"), "row_key", "column_name")


# ---- history from changes -----------------------------------------------------------------------------------------

CHANGE_SCHEMA = "series_id string, row_key string, column_name string, version int, before string, after string"


def changes_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """(series_id, row_key, column_name, version, before, after): the cells that two successive snapshots do not share, by text.
    A cell of a row that comes or goes, or a null, has no text on that side."""
    old = before.select("series_id", "row_key", F.col("row_data").alias("_old"))
    new = after.select("series_id", "row_key", F.col("version").alias("_at"), F.col("row_data").alias("_new"))
    nothing = F.create_map().cast("map<string,string>")
    both = old.join(new, ["series_id", "row_key"], "full").withColumns({"_old": F.coalesce("_old", nothing), "_new": F.coalesce("_new", nothing)})
    names = F.array_union(F.map_keys("_old"), F.map_keys("_new"))
    cells = F.transform(names, lambda c: F.struct(c.alias("column_name"), F.try_element_at("_old", c).alias("before"), F.try_element_at("_new", c).alias("after")))
    differing = F.filter(cells, lambda x: ~x["before"].eqNullSafe(x["after"]))
    version = after.agg(F.max("version")).scalar()
    return both.select("series_id", "row_key", F.explode(differing).alias("c")).select("series_id", "row_key", "c.column_name", version.alias("version"), "c.before", "c.after")


def value_intervals(changes: DataFrame, only_changed: bool = True) -> DataFrame:
    """(series_id, row_key, column_name, valid_from, valid_to, value, changed): which text a cell had from which version on, and
    up to which (not included; null: still). `changed` tells whether its canonical values differ.

    Made of the changes alone: a cell that never changed is not read, and a value that stays for a thousand versions is
    one row. A change tells the value before it, which stands from the change before, or from the first version."""
    one = changes.groupBy("series_id", "row_key", "column_name").agg(F.array_sort(F.collect_list(F.struct("version", "before", "after"))).alias("steps"))
    first = F.struct(F.lit(0).alias("version"), F.element_at("steps", 1)["before"].alias("value"))
    points = F.concat(F.array(first), F.transform("steps", lambda x: F.struct(x["version"].alias("version"), x["after"].alias("value"))))
    spans = F.transform(
        "points", lambda p, i: F.struct(p["version"].alias("valid_from"), F.get("points", i + 1)["version"].alias("valid_to"), p["value"].alias("value"))
    )
    known = F.filter(spans, lambda x: x["value"].isNotNull() & ~F.coalesce(x["valid_from"] == x["valid_to"], F.lit(False)))
    texts = F.array_distinct(F.transform("spans", lambda x: x["value"]))
    differ = F.when(F.size(texts) < 2, False).otherwise(F.size(F.array_distinct(F.transform(texts, canonical))) > 1)
    out = one.withColumn("points", points).withColumn("spans", known).withColumn("changed", differ)
    if only_changed:
        out = out.where("changed")
    return out.select("series_id", "row_key", "column_name", F.explode("spans").alias("s"), "changed").select("series_id", "row_key", "column_name", "s.*", "changed")


def values_at(intervals: DataFrame, versions: DataFrame) -> DataFrame:
    """(series_id, row_key, column_name, version, value): the intervals taken apart again, for the `versions` asked for."""
    inside = (F.col("version") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("version") < F.col("valid_to")))
    asked = versions.select("version").distinct()
    span = F.explode(F.sequence("valid_from", F.greatest("valid_from", F.coalesce(F.col("valid_to"), F.col("_last") + 1) - 1))).alias("version")
    last = asked.agg(F.max("version")).scalar()
    each = intervals.withColumn("_last", last).where("valid_from <= _last").select("series_id", "row_key", "column_name", "valid_from", "valid_to", "value", span)
    return each.where(inside).join(asked, "version", "left_semi").select("series_id", "row_key", "column_name", "version", "value")
