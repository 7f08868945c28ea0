"""Cleaning: trimmed text tables, empty columns and rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from tablematch.config import DEFAULTS, Settings
from tablematch.functions.values import as_text

# bookkeeping columns, never treated as data
INTERNAL = ("_rid",)


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in INTERNAL]


def normalize(df: DataFrame) -> DataFrame:
    """Trimmed headers; every data cell as trimmed text, null as ''. Ordinals stay as they are."""
    types = {f.name: f.dataType for f in df.schema}
    return df.select(
        *[F.col(f"`{c}`") if c in INTERNAL else as_text(F.col(f"`{c}`"), types[c]).alias(c.strip()) for c in df.columns]
    )


def _filled(name: str) -> Column:
    c = F.col(f"`{name}`")
    return F.count_if(c.isNotNull() & (F.trim(c.cast("string")) != ""))


def fill_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Non-blank cells per column plus the row count under '': one aggregate, one row collected."""
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[_filled(c).alias(f"_f{i}") for i, c in enumerate(columns)]).first()
    return {"": row["_rows"], **{c: row[f"_f{i}"] for i, c in enumerate(columns)}}


def drop_unnamed(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Drop columns without a header (`Unnamed: n`, `_cn`) in which fewer than 10 % of the cells are filled."""
    unnamed = [c for c in data_columns(df) if re.match(r"^(Unnamed:.*|_c[0-9]+)$", c)]
    if not unnamed:
        return df
    filled = fill_counts(df, unnamed)
    return df.drop(*[c for c in unnamed if filled[c] == 0 or filled[c] < settings.unnamed_fill_ratio * filled[""]])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns whose cells are all null or blank."""
    names = data_columns(df)
    filled = fill_counts(df, names)
    return df.drop(*[c for c in names if filled[c] == 0])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows whose cells are all null or blank."""
    cells = [F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", F.lit(True)) for c in data_columns(df)]
    return df.where(F.coalesce(*cells, F.lit(False)))


def add_missing_keys(source: DataFrame, target: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Give the side that lacks a key column a blank one; a key column missing on both sides is an error."""
    for key in keys:
        if key not in source.columns and key not in target.columns:
            raise ValueError(f"key column {key!r} is in neither table")
        if key not in source.columns:
            source = source.withColumn(key, F.lit(""))
        if key not in target.columns:
            target = target.withColumn(key, F.lit(""))
    return source, target
