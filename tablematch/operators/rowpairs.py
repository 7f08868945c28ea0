"""Comparison of explicitly paired rows, and the name lookup that proposes pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablematch.config import DEFAULTS, Settings
from tablematch.functions.text import lookup_text, null_like
from tablematch.functions.values import bind
from tablematch.operators.align import loose_pairs
from tablematch.operators.clean import data_columns

_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
FIELD_DIFF = "array<struct<source_field:string,target_field:string,source_value:string,target_value:string,difference:decimal(38,4),status:string>>"


# ---- name lookup --------------------------------------------------------------------------------------------------


def sites(target: DataFrame, name: str, city: str | None = None) -> DataFrame:
    """Target rows by lookup name (and city): the members behind a multiple match."""
    place = lookup_text(F.col(city)) if city else F.lit("")
    return target.select(lookup_text(F.col(name)).alias("name_key"), place.alias("city_key"), F.col("_rid").alias("target_rid")).where(
        "name_key <> ''"
    )


def lookup_names(
    source: DataFrame, target: DataFrame, source_name: str, target_name: str, source_city: str | None = None,
    target_city: str | None = None,
) -> DataFrame:
    """Match source rows to target rows by name; the city only breaks ties.

    One row per source row with method and number of matches. A single match carries its target row; a multiple one
    carries the group (`name_key`, and `city_key` when the city decided) to look up in `sites`, so that a name shared
    by many rows on both sides does not become all their pairs.
    """
    known = sites(target, target_name, target_city)
    by_name = known.groupBy("name_key").agg(F.count("*").alias("n_name"), F.min("target_rid").alias("rid_name"))
    by_city = known.groupBy("name_key", "city_key").agg(F.count("*").alias("n_city"), F.min("target_rid").alias("rid_city"))
    use_city = source_city is not None and target_city is not None
    raw_city = F.coalesce(F.col(source_city).cast("string"), F.lit("")) if use_city else F.lit("")
    rows = source.select(
        F.col("_rid").alias("source_rid"), F.col(source_name).alias("source_name"), lookup_text(F.col(source_name)).alias("name_key"),
        F.when(raw_city != "", lookup_text(raw_city)).alias("city_key"),
    )
    named = rows.where("name_key <> ''").join(by_name, "name_key", "left").join(by_city, ["name_key", "city_key"], "left")
    blank = rows.where("name_key = ''")
    every = named.unionByName(blank, allowMissingColumns=True)
    method = (
        F.when(F.col("n_name").isNull(), "NO MATCH")
        .when(F.col("n_name") == 1, "Name Only")
        .when(F.col("n_city") == 1, "Name+City")
        .when(F.col("n_city") > 1, "Name+City (Multiple Sites)")
        .otherwise("Name Only (Multiple Sites)")
    )
    by_place = F.col("method").startswith("Name+City")
    count = F.when(by_place, F.col("n_city")).otherwise(F.coalesce("n_name", F.lit(0)))
    rid = F.when(by_place, F.col("rid_city")).otherwise(F.col("rid_name"))
    return (
        every.withColumn("method", method).withColumn("match_count", count)
        .select(
            "source_rid", "source_name", "method", "match_count", F.when(F.col("match_count") == 1, rid).alias("target_rid"),
            F.when(F.col("match_count") > 1, F.col("name_key")).alias("name_key"),
            F.when((F.col("match_count") > 1) & by_place, F.col("city_key")).alias("city_key"),
        )
    )


def single_pairs(lookup: DataFrame) -> DataFrame:
    """Pairs of the unambiguous matches whose target is claimed once."""
    found = lookup.where("match_count = 1").select("source_rid", "target_rid")
    once = found.groupBy("target_rid").agg(F.count("*").alias("n")).where("n = 1").select("target_rid")
    return found.join(once, "target_rid", "left_semi").select("source_rid", "target_rid")


# ---- explicit pairs -----------------------------------------------------------------------------------------------


def pair_errors(pairs: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """What is wrong with the pairs: (source_rid, target_rid, error). Empty when they are valid."""
    absent = F.col("source_rid").isNull() | F.col("target_rid").isNull()
    whole = pairs.where(~absent)

    def outside(side: str, table: DataFrame) -> DataFrame:
        ids = table.select(F.col("_rid").alias(f"{side}_rid"))
        return whole.join(ids, f"{side}_rid", "left_anti").withColumn("error", F.lit(f"{side} row does not exist"))

    def repeated(side: str) -> DataFrame:
        often = whole.groupBy(f"{side}_rid").agg(F.count("*").alias("n")).where("n > 1").select(f"{side}_rid")
        return whole.join(often, f"{side}_rid", "left_semi").withColumn("error", F.lit(f"{side} row is used more than once"))

    parts = [
        pairs.where(absent).withColumn("error", F.lit("both row numbers are needed")),
        outside("source", source), outside("target", target), repeated("source"), repeated("target"),
    ]
    out = parts[0].select("source_rid", "target_rid", "error")
    for part in parts[1:]:
        out = out.unionByName(part.select("source_rid", "target_rid", "error"))
    return out


def _judge(x: Column, tolerance: float) -> Column:
    """Field difference of one cell pair, null when the cells agree."""

    def number(c: Column) -> Column:
        bare = F.translate(c, ",$", "")
        return F.when(bare.rlike(_NUMBER), F.trim(bare).try_cast("decimal(38,12)"))

    s, t = x["source_value"], x["target_value"]

    def diff(status: str, source: Column, target: Column, difference: Column) -> Column:
        return F.struct(
            x["source_field"].alias("source_field"), x["target_field"].alias("target_field"), source.alias("source_value"),
            target.alias("target_value"), difference.cast("decimal(38,4)").alias("difference"), F.lit(status).alias("status"),
        )

    def filled(pair: Column) -> Column:
        gap = pair["a"] - pair["b"]
        return F.when(gap.isNotNull(), F.when(F.abs(gap) > F.lit(str(tolerance)).cast("decimal(38,12)"), diff("NUMERIC_MISMATCH", s, t, F.round(gap, 4)))).when(
            F.trim(s) != F.trim(t), diff("STRING_MISMATCH", s, t, F.lit(None))
        )

    empty_s, empty_t = null_like(s), null_like(t)
    return (
        F.when(empty_s & empty_t, F.lit(None))
        .when(empty_s, diff("MISMATCH", F.lit(None).cast("string"), t, F.lit(None)))
        .when(empty_t, diff("MISMATCH", s, F.lit(None).cast("string"), F.lit(None)))
        .otherwise(bind(F.struct(number(s).alias("a"), number(t).alias("b")), filled))
    )


def compare_row_pairs(
    source: DataFrame, target: DataFrame, pairs: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Pairs (source_rid, target_rid) with status MATCHED or MISMATCHED and the field differences."""
    s = source.select(F.col("_rid").alias("source_rid"), F.struct(*data_columns(source)).alias("src"))
    t = target.select(F.col("_rid").alias("target_rid"), F.struct(*data_columns(target)).alias("tgt"))
    cells = [
        F.struct(
            F.lit(a).alias("source_field"), F.lit(b).alias("target_field"), F.col("src").getField(a).cast("string").alias("source_value"),
            F.col("tgt").getField(b).cast("string").alias("target_value"),
        )
        for a, b in loose_pairs(data_columns(source), data_columns(target))
    ]
    differing = F.filter(F.array(*cells), lambda x: ~x["source_value"].eqNullSafe(x["target_value"]))
    found = F.filter(F.transform(differing, lambda x: _judge(x, settings.amount_tolerance)), lambda d: d.isNotNull())
    joined = pairs.join(s, "source_rid").join(t, "target_rid").withColumn("differences", found.cast(FIELD_DIFF))
    return joined.withColumn("status", F.when(F.size("differences") == 0, "MATCHED").otherwise("MISMATCHED"))


def unmapped(table: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """Rows of a side that are in no pair."""
    return table.join(pairs.select(F.col(f"{side}_rid").alias("_rid")).distinct(), "_rid", "left_anti")


def pair_summary(source: DataFrame, target: DataFrame, pairs: DataFrame, compared: DataFrame) -> DataFrame:
    """Counts of a row-pair comparison as (metric, value) rows."""

    def one(df: DataFrame, **metrics: Column) -> DataFrame:
        return df.agg(*[v.cast("long").alias(k) for k, v in metrics.items()]).unpivot([], list(metrics), "metric", "value")

    n = F.count(F.lit(1))
    return (
        one(source, total_source_rows=n).unionByName(one(target, total_target_rows=n))
        .unionByName(one(
            compared, mapped_pairs_count=n, matched_pairs_count=F.count_if(F.col("status") == "MATCHED"),
            mismatched_pairs_count=F.count_if(F.col("status") == "MISMATCHED"),
        ))
        .unionByName(one(unmapped(source, pairs, "source"), unmapped_source_count=n))
        .unionByName(one(unmapped(target, pairs, "target"), unmapped_target_count=n))
    )


# ---- previews -----------------------------------------------------------------------------------------------------


def search_rows(df: DataFrame, text: str) -> DataFrame:
    """Rows whose ordinal or `column:value` text contains the text, ignoring case."""
    wanted = (text or "").strip().lower()
    if not wanted:
        return df
    row = F.concat_ws(" ", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in data_columns(df)])
    return df.where(F.col("_rid").cast("string").contains(wanted) | F.lower(row).contains(wanted))


def preview_page(df: DataFrame, page: int = 1, page_size: int = 20, text: str = "") -> DataFrame:
    """One page of rows in row order. Without a search the page is a range of ordinals, so nothing is sorted."""
    start = (page - 1) * page_size
    if not (text or "").strip():
        return df.where((F.col("_rid") >= start) & (F.col("_rid") < start + page_size))
    return search_rows(df, text).orderBy("_rid").offset(start).limit(page_size)
