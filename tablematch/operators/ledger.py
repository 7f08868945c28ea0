"""Ledger comparison on canonical fields: totals per transaction, tolerance, suffix tier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tablematch.config import DEFAULTS, Settings
from tablematch.functions.text import null_like, strip_suffix
from tablematch.functions.values import within_tolerance
from tablematch.operators.master import duplicate_keys
from tablematch.plans.skew import durable

KEY = ["TxnNumber", "TxnType"]
MONEY = "decimal(28,2)"


@dataclass
class Ledger:
    """Result of a ledger comparison: `groups` holds one row per transaction (pair) with its status."""

    groups: DataFrame
    clean_source: DataFrame
    clean_target: DataFrame
    exceptions_source: DataFrame
    exceptions_target: DataFrame
    duplicates_source: DataFrame
    duplicates_target: DataFrame
    tolerance: float


def type_usable(source: DataFrame, target: DataFrame) -> bool:
    """Does TxnType hold a value on both sides? Each look stops at the first value found."""
    return all(not df.where(~null_like(F.col("TxnType"))).isEmpty() for df in (source, target))


def flag_exceptions(df: DataFrame, by_type: bool) -> DataFrame:
    """Add `reason`: why a row cannot take part, null for clean rows. With a usable type, a row without one is an
    exception too, since it could not be found in any group. Numbers are trimmed; an unusable type is blanked."""
    reason = F.when(null_like(F.col("TxnNumber")), "blank number").when(F.col("Amount").isNull(), "no amount")
    if by_type:
        reason = reason.when(null_like(F.col("TxnType")), "blank type")
    return (
        df.withColumn("reason", reason)
        .withColumn("TxnNumber", F.coalesce(F.trim(F.col("TxnNumber").cast("string")), F.lit("")))
        .withColumn("TxnType", F.coalesce(F.col("TxnType"), F.lit("")) if by_type else F.lit(""))
    )


def split_exceptions(df: DataFrame, by_type: bool) -> tuple[DataFrame, DataFrame]:
    flagged = flag_exceptions(df, by_type)
    return flagged.where("reason is null").drop("reason"), flagged.where("reason is not null")


def totals_by_key(clean: DataFrame) -> DataFrame:
    """Amount per transaction, with the first known date and customer and the number of lines. Partial sums run before the shuffle."""

    def first_known(name: str) -> Column:
        known = F.when(F.col(name).isNotNull(), F.col("_rid"))
        return F.min_by(F.col(name), known).alias(name)

    return clean.groupBy(*KEY).agg(
        F.sum("Amount").cast(MONEY).alias("Amount"), first_known("TxnDate"), first_known("Customer"), F.count(F.lit(1)).alias("Lines")
    )


def outer_groups(source: DataFrame, target: DataFrame, tolerance: float) -> DataFrame:
    """Totals of both sides side by side with difference and first-tier status."""

    def side(df: DataFrame, name: str) -> DataFrame:
        values = [F.col(c).alias(f"{c}_{name}") for c in ("Amount", "TxnDate", "Customer", "Lines")]
        return totals_by_key(df).select(*KEY, *values, F.lit(True).alias(f"in_{name}"))

    joined = side(source, "Source").join(side(target, "Target"), KEY, "full")
    both = F.col("in_Source").isNotNull() & F.col("in_Target").isNotNull()
    diff = F.when(both, F.col("Amount_Source") - F.col("Amount_Target"))
    status = (
        F.when(F.col("in_Target").isNull(), "Only In Source")
        .when(F.col("in_Source").isNull(), "Only In Target")
        .when(within_tolerance(F.col("Amount_Source"), F.col("Amount_Target"), tolerance), "Matched")
        .otherwise("Amount Mismatch")
    )
    return joined.withColumn("Diff", diff.cast(MONEY)).withColumn("MatchStatus", status).drop("in_Source", "in_Target")


def suffix_matches(groups: DataFrame, tolerance: float) -> DataFrame:
    """Second tier: one-sided groups whose number without a trailing '-digits' is the same on both sides. Only a
    stripped number held by exactly one group per side is taken; the others stay one-sided."""
    left = groups.where("MatchStatus in ('Only In Source', 'Only In Target')").withColumn("Stem", strip_suffix(F.col("TxnNumber")))
    fields = ["TxnNumber", "Amount_{0}", "TxnDate_{0}", "Customer_{0}", "Lines_{0}"]

    def only(name: str) -> list[Column]:
        test = F.col("MatchStatus") == f"Only In {name}"
        picked = [
            F.min(F.when(test, F.col(f.format(name)))).alias(f.format(name) if "{" in f else f"TxnNumber_{name}") for f in fields
        ]
        return [F.count_if(test).alias(f"n_{name}"), *picked]

    return (
        left.groupBy("Stem", "TxnType").agg(*only("Source"), *only("Target"))
        .where("n_Source = 1 and n_Target = 1")
        .withColumn("Diff", (F.col("Amount_Source") - F.col("Amount_Target")).cast(MONEY))
        .withColumn(
            "MatchStatus",
            F.when(within_tolerance(F.col("Amount_Source"), F.col("Amount_Target"), tolerance), "Tier2 Match")
            .otherwise("Tier2 Amount Mismatch"),
        )
        .drop("n_Source", "n_Target")
    )


def compare_ledger(source: DataFrame, target: DataFrame, settings: Settings = DEFAULTS) -> Ledger:
    """Compare canonical tables (TxnNumber, TxnType, TxnDate, Amount, Customer, _rid)."""
    tolerance = settings.amount_tolerance
    by_type = type_usable(source, target)
    s, s_bad = split_exceptions(source, by_type)
    t, t_bad = split_exceptions(target, by_type)
    # read three times below: written once, so that the lines are aggregated and joined once
    groups = durable(outer_groups(s, t, tolerance))
    tier2 = suffix_matches(groups, tolerance)
    stemmed = groups.withColumn("Stem", strip_suffix(F.col("TxnNumber")))
    both = stemmed.where("MatchStatus in ('Matched', 'Amount Mismatch')")
    alone = stemmed.where("MatchStatus not in ('Matched', 'Amount Mismatch')").join(
        tier2.select("Stem", "TxnType"), ["Stem", "TxnType"], "left_anti"
    )
    in_source = F.col("MatchStatus") != "Only In Target"
    in_target = F.col("MatchStatus") != "Only In Source"
    tier1 = both.unionByName(alone).withColumn("TxnNumber_Source", F.when(in_source, F.col("TxnNumber"))).withColumn(
        "TxnNumber_Target", F.when(in_target, F.col("TxnNumber"))
    )
    columns = [
        "TxnNumber_Source", "TxnNumber_Target", "TxnType", "Amount_Source", "Amount_Target", "Diff", "MatchStatus",
        "TxnDate_Source", "TxnDate_Target", "Customer_Source", "Customer_Target",
        "Lines_Source", "Lines_Target",
    ]
    return Ledger(
        tier1.select(*columns).unionByName(tier2.select(*columns)),
        s, t, s_bad, t_bad,
        s.join(duplicate_keys(s, KEY).select(*KEY), KEY, "left_semi"),
        t.join(duplicate_keys(t, KEY).select(*KEY), KEY, "left_semi"),
        tolerance,
    )


def ledger_summary(ledger: Ledger) -> DataFrame:
    """All counts and totals as (metric, value) rows. The groups carry what their lines add up to, so one pass over
    them gives everything but the exceptions."""

    def rows(df: DataFrame, **metrics: Column) -> DataFrame:
        one = df.agg(*[F.coalesce(v, F.lit(0)).cast(MONEY).alias(k) for k, v in metrics.items()])
        return one.unpivot([], list(metrics), "metric", "value")

    def count_status(*names: str) -> Column:
        return F.count_if(F.col("MatchStatus").isin(*names))

    def side(name: str) -> dict[str, Column]:
        lines, total = F.col(f"Lines_{name}"), F.sum(f"Amount_{name}")
        low = name.lower()
        return {
            f"{low}_records": F.count(lines), f"duplicate_keys_{low}": F.sum(F.when(lines > 1, lines)),
            f"{low}_invoice_total": total, f"{low}_total": total,
        }

    gap = F.sum(F.coalesce("Amount_Source", F.lit(0)) - F.coalesce("Amount_Target", F.lit(0)))
    return (
        rows(
            ledger.groups,
            **side("Source"), **side("Target"),
            matched=count_status("Matched"), amount_mismatch=count_status("Amount Mismatch"),
            only_in_source=count_status("Only In Source"), only_in_target=count_status("Only In Target"),
            tier2_matches=count_status("Tier2 Match", "Tier2 Amount Mismatch"), invoice_difference=gap, net_diff=gap,
        )
        .unionByName(rows(ledger.exceptions_source, source_exceptions=F.count(F.lit(1))))
        .unionByName(rows(ledger.exceptions_target, target_exceptions=F.count(F.lit(1))))
    )


def require_fields(mapping: dict[str, str | None], fields: tuple = ("TxnNumber", "Amount")) -> None:
    """Stop before any job when a required canonical field is not mapped."""
    absent = [f for f in fields if not mapping.get(f)]
    if absent:
        raise ValueError(f"required fields are not mapped: {', '.join(absent)}")
