"""Column profiles, logical types, key and file-type detection.

Profiles run on the long form (column, value): sums per column combine before the shuffle, and distinct values are
counted by grouping (column, value), so no column's values meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tablematch.config import (
    BOOLEAN_WORDS, BUSINESS_KEY_HINTS, CUSTOMER_NAMES, DATE_NAMES, DEFAULTS, DOCUMENT_WORDS, DUE_NAMES, KEY_NAMES,
    KEY_SCORE_HINTS, TRANSACTION_WORDS, Settings,
)
from tablematch.functions.text import flat_name, spaced_name
from tablematch.functions.validate import is_date, is_email, is_identifier, is_phone, share
from tablematch.functions.values import parse_date
from tablematch.operators.clean import data_columns
from tablematch.plans.skew import top_per_group
from tablematch.vocabulary import words_of

SAMPLES = 5


def _is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def _is_integer(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType)


def long_form(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(pos, column_name, value, num, _rid) for every non-null cell; num for numeric columns."""
    types = {f.name: f.dataType for f in df.schema}
    cells = [
        F.struct(
            F.lit(i).alias("pos"), F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value"),
            (F.col(f"`{c}`") if _is_number(types[c]) else F.lit(None)).cast("double").alias("num"),
        )
        for i, c in enumerate(columns or data_columns(df))
    ]
    rid = F.col("_rid") if "_rid" in df.columns else F.lit(0).cast("long").alias("_rid")
    return df.select(rid, F.inline(F.array(*cells))).where(F.col("value").isNotNull())


def distinct_counts(long: DataFrame) -> DataFrame:
    """Exact distinct values per column."""
    return long.select("column_name", "value").distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_count"))


def medians(long: DataFrame) -> DataFrame:
    """Exact median per numeric column, interpolated, from distinct values and how often they come."""
    counted = long.where("num IS NOT NULL").groupBy("column_name", "num").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("column_name").agg(F.percentile("num", 0.5, F.col("n")).alias("median_val"))


def head_values(long: DataFrame, n: int) -> DataFrame:
    """First `n` non-null values per column in row order; limited before the shuffle."""
    return top_per_group(long, ["column_name"], [F.col("_rid")], n)


def profile(df: DataFrame, exact: bool = True, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per column: counts, distinct values, numeric statistics, mean length, samples, logical type."""
    columns = data_columns(df)
    types = {f.name: f.dataType for f in df.schema}
    long = long_form(df)
    trimmed = F.trim(F.col("value"))
    median = F.percentile_approx("num", 0.5, settings.median_accuracy).alias("median_val")
    unique = [] if exact else [F.approx_count_distinct("value").alias("unique_count"), median]
    stats = long.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("non_null_count"),
        F.min("num").alias("min_val"),
        F.max("num").alias("max_val"),
        F.avg("num").alias("mean_val"),
        F.coalesce(F.stddev_samp("num"), F.when(F.count("num") > 0, F.lit(0.0))).alias("std_val"),
        F.round(F.avg(F.length("value")), 2).alias("mean_length"),
        F.min(F.lower(trimmed).isin(*BOOLEAN_WORDS)).alias("boolean_like"),
        share(is_email(trimmed)).alias("email_share"),
        share(is_phone(trimmed)).alias("phone_share"),
        share(is_identifier(trimmed)).alias("id_share"),
        share(is_date(trimmed)).alias("date_share"),
        F.max(F.col("value").contains(":")).alias("timed"),
        *unique,
    )
    if exact:
        stats = stats.join(distinct_counts(long), "column_name", "left").join(medians(long), "column_name", "left")
    heads = head_values(long.select("column_name", "value", "_rid"), SAMPLES)
    heads = heads.groupBy("column_name").agg(F.sort_array(F.collect_list(F.struct("_rid", "value"))).alias("head"))
    frame = df.sparkSession.createDataFrame(
        [
            (i, c, spaced_name(c), types[c].simpleString(), _is_number(types[c]), _is_integer(types[c]), isinstance(types[c], T.StringType))
            for i, c in enumerate(columns)
        ],
        "pos int, column_name string, normalized_name string, data_type string, numeric boolean, integral boolean, textual boolean",
    )
    rows = df.agg(F.count(F.lit(1))).scalar()
    counted = (
        frame.join(stats, "column_name", "left").join(heads, "column_name", "left")
        .withColumn("total_rows", rows)
        .withColumn("non_null_count", F.coalesce("non_null_count", F.lit(0)))
        .withColumn("unique_count", F.coalesce("unique_count", F.lit(0)))
    )
    unique_ratio = F.round(F.col("unique_count") / F.nullif(F.col("non_null_count"), F.lit(0)), 4)
    nulls = F.col("total_rows") - F.col("non_null_count")
    out = (
        counted.withColumn("null_count", nulls)
        .withColumn("null_percentage", F.coalesce(F.round(nulls / F.nullif(F.col("total_rows"), F.lit(0)) * 100.0, 2), F.lit(0.0)))
        .withColumn("uniqueness_ratio", F.coalesce(unique_ratio, F.lit(0.0)))
        .withColumn("duplicate_count", F.col("non_null_count") - F.col("unique_count"))
        .withColumn("avg_str_length", F.when(F.col("numeric"), 0.0).otherwise(F.coalesce("mean_length", F.lit(0.0))))
        .withColumn("sample_values", F.transform("head", lambda x: x["value"]))
    )
    return out.withColumn("inferred_logical_type", logical_type()).drop(
        "mean_length", "head", "boolean_like", "email_share", "phone_share", "id_share", "date_share", "timed",
        "numeric", "integral", "textual",
    )


def logical_type() -> Column:
    """Logical type of a profiled column; the first test that holds decides."""
    whole = F.col("integral") | F.col("textual")
    return (
        F.when(F.col("non_null_count") == 0, "String")
        .when(whole & F.col("boolean_like"), "Boolean")
        .when(F.col("integral") & (F.col("uniqueness_ratio") > 0.85), "Identifier")
        .when(F.col("integral"), "Integer")
        .when(F.col("numeric"), "Decimal")
        .when((F.col("date_share") >= 0.7) & F.col("timed"), "Datetime")
        .when(F.col("date_share") >= 0.7, "Date")
        .when(F.col("email_share") >= 0.7, "Email")
        .when(F.col("phone_share") >= 0.7, "Phone")
        .when((F.col("uniqueness_ratio") >= 0.85) & (F.col("id_share") >= 0.85), "Identifier")
        .when((F.col("uniqueness_ratio") <= 0.20) & (F.col("unique_count") <= 50), "Categorical")
        .when(F.col("avg_str_length") > 40, "Free Text")
        .otherwise("String")
    )


def key_candidates(profiles: DataFrame) -> DataFrame:
    """Columns ranked by how well they would serve as a key."""
    hint = F.col("normalized_name").rlike("|".join(KEY_SCORE_HINTS))
    score = (
        F.col("uniqueness_ratio") * 0.55
        + (F.lit(100.0) - F.col("null_percentage")) / 100.0 * 0.25
        + F.when(hint, 0.20).otherwise(0.0)
    )
    return profiles.select(
        "pos", "column_name", F.round(score, 4).alias("score"), "uniqueness_ratio", "null_percentage",
        F.col("inferred_logical_type").alias("logical_type"),
    ).orderBy(F.desc("score"), "pos")


def uniqueness(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, int]]:
    """{column: (distinct, filled)} over non-blank cells; one row per column is collected."""
    long = long_form(df, columns).select("column_name", F.trim("value").alias("value")).where("value <> ''")
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n")).collect()
    found = {r["column_name"]: (r["d"], r["n"]) for r in rows}
    return {c: found.get(c, (0, 0)) for c in columns}


def guess_key_columns(source: DataFrame, target: DataFrame, settings: Settings = DEFAULTS) -> list[str]:
    """Key by name, else the most unique common column from 0.9 on, else the first common (or first source) column.
    Data is read only when no name helps."""
    common = [c for c in data_columns(source) if c in target.columns]
    if not common:
        return data_columns(source)[:1]
    lower = {c.lower(): c for c in common}
    named = next((lower[k] for k in KEY_NAMES if k in lower), None)
    if named:
        return [named]
    best, best_ratio = common[0], 0.0
    for c, (distinct, filled) in uniqueness(source, common).items():
        if filled and distinct / filled > best_ratio:
            best, best_ratio = c, distinct / filled
    return [best if best_ratio >= settings.key_uniqueness else common[0]]


def detect_business_key(df: DataFrame) -> str | None:
    """Column that reads like an identifier; among several the first without repeated values."""
    columns = data_columns(df)
    named = [c for c in columns if any(h in c.strip().lower().replace("_", "").replace(" ", "") for h in BUSINESS_KEY_HINTS)]
    if len(named) <= 1:
        return (named or columns or [None])[0]
    long = long_form(df, named)
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy("column_name").agg(F.max("n").alias("most")).collect()
    unique = {r["column_name"] for r in rows if r["most"] == 1}
    return next((c for c in named if c in unique), named[0])


def duplicate_share(df: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the rows whose key occurs more than once."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    repeated = F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0))
    return sizes.agg(F.coalesce(repeated / F.sum("n"), F.lit(0.0)).alias("share"))


def resolve_data_type(
    requested: str | None, source: DataFrame, target: DataFrame, keys: list[str], settings: Settings = DEFAULTS
) -> str:
    """'master' or 'transactional': the request, else the column names, else the share of repeated keys."""
    wanted = (requested or "auto").strip().lower()
    if wanted in ("master", "transactional"):
        return wanted
    if wanted not in ("", "auto"):
        raise ValueError("data type must be 'auto', 'master' or 'transactional'")
    common = [c.lower() for c in data_columns(source) if c in target.columns]
    shaped = sum(any(w in c for w in TRANSACTION_WORDS) for c in common) >= 2
    identified = any(w in c for c in common for w in DOCUMENT_WORDS)
    if not keys:
        return "transactional" if shaped else "master"
    if shaped and identified:
        return "transactional"
    shares = [duplicate_share(df, keys).first()["share"] for df in (source, target)]
    return "transactional" if max(shares) >= settings.transactional_duplicate_ratio else "master"


def detect_date_column(source: DataFrame, target: DataFrame, settings: Settings = DEFAULTS) -> str | None:
    """Known name, else a name with 'date' (those ending in it first), else the best-parsing column above 80 %."""
    lower = {c.lower(): c for c in data_columns(source)}
    theirs = {c.lower() for c in data_columns(target)}
    common = [k for k in lower if k in theirs]
    named = next((k for k in DATE_NAMES if k in common), None)
    if named:
        return lower[named]
    dated = sorted([k for k in common if "date" in k], key=lambda k: (not k.endswith("date"), k))
    if dated:
        return lower[dated[0]]
    if not common:
        return None
    long = long_form(source, [lower[k] for k in common]).where(F.trim("value") != "")
    rows = long.groupBy("pos", "column_name").agg(share(is_date(F.trim("value"))).alias("r")).collect()
    best = max(rows, key=lambda r: (r["r"], -r["pos"]), default=None)
    return best["column_name"] if best and best["r"] > settings.date_parse_ratio else None


def file_type_facts(df: DataFrame) -> DataFrame:
    """Per column what the file-type signals need: filled, dates, distinct dates, numbers and their range, distinct."""
    long = long_form(df).select("pos", "column_name", F.trim("value").alias("value")).where("value <> ''")
    cells = long.groupBy("pos", "column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    number = F.regexp_replace("value", r"[^0-9.\-(]", "")
    number = F.when(number.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"), number.try_cast("double"))
    parsed = cells.withColumn("day", parse_date(F.col("value"))).withColumn("num", number)
    per_day = parsed.groupBy("pos", "column_name", "day").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"), F.min("num").alias("lo"), F.max("num").alias("hi"),
        F.coalesce(F.sum(F.when(F.col("num").isNotNull(), F.col("n"))), F.lit(0)).alias("n_num"),
    )
    return per_day.groupBy("pos", "column_name").agg(
        F.sum("n").alias("filled"), F.sum("d").alias("distinct_values"),
        F.coalesce(F.sum(F.when(F.col("day").isNotNull(), F.col("n"))), F.lit(0)).alias("dates"),
        F.count("day").alias("distinct_dates"), F.sum("n_num").alias("numbers"),
        F.min("lo").alias("low"), F.max("hi").alias("high"),
    )


def detect_file_type(df: DataFrame, vocabulary: dict[str, dict[str, list[str]]]) -> dict:
    """Transactional, master or ambiguous, from five weighted signals. One row per column is collected."""
    columns = data_columns(df)
    flat = [flat_name(c) for c in columns]
    facts = {r["column_name"]: r for r in file_type_facts(df).collect()}
    rows = df.count()
    signals, score = [], 0.0
    txn, master = (sum(f in words_of(vocabulary.get(k, {})) for f in flat) for k in ("transactional", "master"))
    if txn > master:
        score += 0.35
        signals.append(f"headers match the transactional vocabulary ({txn} fields)")
    elif master > txn:
        score -= 0.35
        signals.append(f"headers match the master vocabulary ({master} fields)")
    known = [facts[c] for c in columns if c in facts]
    dated = next((f for f in known if f["dates"] / f["filled"] > 0.7 and f["distinct_dates"] > max(5, rows * 0.1)), None)
    if dated:
        score += 0.25
        signals.append(f"date column '{dated['column_name']}' with a wide range")
    elif rows > 10:
        score -= 0.10
    money = next((f for f in known if f["numbers"] > max(3, rows * 0.5) and f["low"] < f["high"]), None)
    if money:
        score += 0.20
        signals.append(f"money column '{money['column_name']}' varies per row")
    first = facts.get(columns[0]) if columns else None
    if first:
        if first["distinct_values"] / first["filled"] > 0.9:
            customer = next((c for c in columns if flat_name(c) in CUSTOMER_NAMES), None)
            repeats = facts[customer]["distinct_values"] if customer in facts else 1
            if customer and repeats / max(rows, 1) < 0.5:
                score += 0.20
                signals.append("customer repeats across rows")
        else:
            score -= 0.15
            signals.append("first column repeats often")
    if any(f in DUE_NAMES for f in flat):
        score += 0.20
        signals.append("due date or aging column")
    score = round(score, 3)
    if abs(score) >= 0.25:
        kind, confidence = ("transactional" if score > 0 else "master"), min(1.0, 0.5 + abs(score))
    else:
        kind, confidence = "ambiguous", 0.5 - abs(score)
    return {"type": kind, "confidence": round(confidence, 2), "signals": signals, "raw_score": score}
