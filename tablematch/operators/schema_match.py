"""Matching the columns of two tables by eight weighted signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablematch.config import DEFAULTS, Settings
from tablematch.functions.text import confidence_band, name_ratios, token_overlap
from tablematch.operators.clean import data_columns
from tablematch.operators.profile import key_candidates, long_form, profile
from tablematch.plans.assign import assign_columns


def column_values(df: DataFrame) -> DataFrame:
    """Distinct trimmed values of each column."""
    return long_form(df).select("column_name", F.trim("value").alias("value")).distinct()


def value_overlap(source: DataFrame, target: DataFrame) -> DataFrame:
    """Shared over all values of every column pair that shares any."""
    s, t = column_values(source), column_values(target)
    n_s = s.groupBy(F.col("column_name").alias("source_column")).agg(F.count("*").alias("n_s"))
    n_t = t.groupBy(F.col("column_name").alias("target_column")).agg(F.count("*").alias("n_t"))
    shared = (
        s.withColumnRenamed("column_name", "source_column")
        .join(t.withColumnRenamed("column_name", "target_column"), "value")
        .groupBy("source_column", "target_column").agg(F.count("*").alias("both"))
    )
    joined = shared.join(n_s, "source_column").join(n_t, "target_column")
    return joined.select(
        "source_column", "target_column", (F.col("both") / (F.col("n_s") + F.col("n_t") - F.col("both"))).alias("overlap")
    )


def _family(*names: str) -> Column:
    return F.col("s_type").isin(*names) & F.col("t_type").isin(*names)


def column_signals(
    source: DataFrame, target: DataFrame, pair_id: str = "pair", exact: bool = True, settings: Settings = DEFAULTS
) -> DataFrame:
    """All column pairs of one table pair with the eight signals and the weighted confidence. The rows are profiles,
    so their number is bounded by the two schemas."""

    def side(df: DataFrame, p: str) -> DataFrame:
        return profile(df, exact, settings).select(
            F.lit(pair_id).alias("pair_id"), F.col("pos").alias(f"{p}_pos"), F.col("column_name").alias(f"{p}_column"),
            F.col("normalized_name").alias(f"{p}_name"), F.col("inferred_logical_type").alias(f"{p}_type"),
            F.col("avg_str_length").alias(f"{p}_length"), F.col("uniqueness_ratio").alias(f"{p}_unique"),
            F.col("null_percentage").alias(f"{p}_null"),
        )

    overlap = value_overlap(source, target).select(
        F.col("source_column").alias("s_column"), F.col("target_column").alias("t_column"), "overlap"
    )
    ratios = name_ratios(source.sparkSession, data_columns(source), data_columns(target)).toDF("s_column", "t_column", "ratio")
    pairs = side(source, "s").join(side(target, "t"), "pair_id").join(overlap, ["s_column", "t_column"], "left")
    pairs = pairs.join(ratios, ["s_column", "t_column"])
    contained = (F.length("s_name") > 0) & (F.length("t_name") > 0) & (
        F.col("t_name").contains(F.col("s_name")) | F.col("s_name").contains(F.col("t_name"))
    )
    same = F.col("s_type") == F.col("t_type")
    signals = {
        "header_similarity": F.when(contained, F.greatest("ratio", F.lit(settings.column_containment_score))).otherwise(F.col("ratio")),
        "datatype_compatibility": F.when(same, 1.0).when(_family("Date", "Datetime"), 0.9)
        .when(_family("Integer", "Decimal", "Identifier"), 0.8).otherwise(0.4),
        "value_overlap": F.coalesce("overlap", F.lit(0.0)),
        "pattern_similarity": F.when(same & F.col("s_type").isin("Email", "Phone", "Identifier", "Date", "Datetime"), 1.0).otherwise(0.5),
        "profile_similarity": F.when(
            F.col("s_length") > 0, F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(F.col("s_length") - F.col("t_length")) / 50.0)
        ).otherwise(0.7),
        "semantic_similarity": token_overlap(F.col("s_name"), F.col("t_name")),
        "uniqueness_compatibility": F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(F.col("s_unique") - F.col("t_unique"))),
        "null_compatibility": F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(F.col("s_null") - F.col("t_null")) / 100.0),
    }
    scored = pairs.select(
        "pair_id", F.col("s_pos").alias("source_pos"), F.col("t_pos").alias("target_pos"),
        F.col("s_column").alias("source_column"), F.col("t_column").alias("target_column"),
        *[F.round(v, 4).alias(k) for k, v in signals.items()],
    )
    total = F.lit(0.0)
    for name, weight in settings.signal_weights.items():
        total = total + F.col(name) * weight
    return scored.withColumn("confidence", F.round(total, 4)).withColumn("category", confidence_band(F.col("confidence")))


def recommend(signals: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Optimal one-to-one mapping per table pair; weak and left-over source columns are marked __ignore__."""
    chosen = assign_columns(signals.select("pair_id", "source_pos", "target_pos", F.col("confidence").alias("score")))
    best = signals.join(chosen, ["pair_id", "source_pos", "target_pos"]).where(F.col("confidence") >= settings.assignment_accept)
    everyone = signals.select("pair_id", "source_pos", "source_column").distinct()
    picked = best.select("pair_id", "source_pos", "target_column", "confidence", "category")
    return everyone.join(picked, ["pair_id", "source_pos"], "left").select(
        "pair_id", "source_pos", "source_column",
        F.coalesce("target_column", F.lit("__ignore__")).alias("recommended_target"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("category", F.lit("UNMAPPED")).alias("category"),
    )


def suggested_key(df: DataFrame, exact: bool = True, settings: Settings = DEFAULTS) -> str | None:
    """Best key candidate of a table."""
    first = key_candidates(profile(df, exact, settings)).limit(1).collect()
    return first[0]["column_name"] if first else None
