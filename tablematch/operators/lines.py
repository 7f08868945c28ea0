"""Line comparison: repeated keys are legal and every line is paired exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

from tablematch.config import AMOUNT_WORDS, DEFAULTS, Settings
from tablematch.functions.values import canonical
from tablematch.operators.cells import Layout, compare_pairs, layout_of
from tablematch.operators.clean import data_columns
from tablematch.operators.master import Comparison
from tablematch.plans.skew import find_hot, ranked


def find_hot_keys(source: DataFrame, target: DataFrame, layout: Layout, settings: Settings = DEFAULTS) -> DataFrame | None:
    """Keys with too many lines for one task, over both tables."""
    return find_hot(source.select(*layout.keys).unionByName(target.select(*layout.keys)), layout.keys, settings)


def _printed(df: DataFrame, layout: Layout, side: str, carry: list[str] | None = None) -> DataFrame:
    """Rows as (keys, _rid, _print, struct) with the fingerprint of the compared cells. The struct holds `_rid` and the
    columns `carry`, all data columns if none are told."""
    cells = [canonical(F.col(f"`{c}`")) for c in layout.compare]
    print_ = F.unhex(F.md5(F.concat_ws("\x1f", *cells)))
    return df.select(*layout.keys, "_rid", print_.alias("_print"), F.struct(*(data_columns(df) if carry is None else carry), "_rid").alias(side))


def _numbered(df: DataFrame, layout: Layout, side: str, hot: DataFrame | None, settings: Settings, carry: list[str] | None) -> DataFrame:
    """Rows with their fingerprint and their occurrence number inside (key, fingerprint)."""
    tagged = _printed(df, layout, side, carry)
    return ranked(tagged, [*layout.keys, "_print"], "_rid", "_nth", hot, layout.keys, settings).drop("_rid")


def identical_lines(
    source: DataFrame, target: DataFrame, layout: Layout, hot: DataFrame | None, settings: Settings = DEFAULTS,
    carry: list[str] | None = None,
) -> DataFrame:
    """Pair the k-th with the k-th of the identical lines inside a key; lines without a partner keep a null side.
    The join key (key, fingerprint, k) is unique on both sides, so it cannot be skewed. Without hot keys both tables are
    partitioned once, by key, and stay so for the pairing of the lines left over. Where the ordinals are enough, `carry=[]` leaves the cells behind."""
    if hot is None:
        rows = _by_key(source, target, layout, carry)
        return _partners(rows, Window.partitionBy(*layout.keys, "_print", "_nth"), layout.keys)
    s = _numbered(source, layout, "src", hot, settings, carry)
    t = _numbered(target, layout, "tgt", hot, settings, carry)
    return s.join(t, [*layout.keys, "_print", "_nth"], "full").drop("_print", "_nth")


def leftover_lines(unpaired: DataFrame, layout: Layout, hot: DataFrame | None, settings: Settings = DEFAULTS) -> DataFrame:
    """Pair the remaining lines of a key by position; the surplus stays one-sided. Both sides are numbered in one
    pass and brought together by (key, position), which holds one line per side."""
    sided = unpaired.select(
        *layout.keys, "src", "tgt",
        F.col("src").isNull().alias("_side"),
        F.coalesce(F.col("src._rid"), F.col("tgt._rid")).alias("_order"),
    )
    numbered = ranked(sided, [*layout.keys, "_side"], "_order", "_nth", hot, layout.keys, settings)
    return numbered.groupBy(*layout.keys, "_nth").agg(
        F.first("src", ignorenulls=True).alias("src"), F.first("tgt", ignorenulls=True).alias("tgt")
    ).drop("_nth")


def _by_key(source: DataFrame, target: DataFrame, layout: Layout, carry: list[str] | None = None) -> DataFrame:
    """The lines of both tables, partitioned by key, with side (0, 1) and occurrence number inside (key, fingerprint)."""
    s = _printed(source, layout, "src", carry).withColumn("_side", F.lit(0))
    t = _printed(target, layout, "tgt", carry).withColumn("_side", F.lit(1))
    rows = s.unionByName(t, allowMissingColumns=True).repartition(*layout.keys)
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*layout.keys, "_print", "_side").orderBy("_rid")))


def _partners(rows: DataFrame, group: WindowSpec, keys: list[str]) -> DataFrame:
    """Bring the lines of a group, one per side at most, into one row (keys, src, tgt)."""
    pair = group.orderBy("_side")
    rows = rows.withColumn("_next", F.lead("tgt").over(pair)).withColumn("_before", F.lag("_side").over(pair))
    return rows.where("_before is null").select(*keys, "src", F.coalesce("_next", "tgt").alias("tgt"))


def _pair_by_key(source: DataFrame, target: DataFrame, layout: Layout) -> DataFrame:
    """Both pairings with a single shuffle, by key: every window below is partitioned by the key and more, so it runs
    on that partitioning. For tables without hot keys."""
    keys = layout.keys
    rows = _by_key(source, target, layout)
    same = Window.partitionBy(*keys, "_print")
    rows = rows.withColumn("_exact", F.col("_nth") <= F.least(F.sum(F.lit(1) - F.col("_side")).over(same), F.sum("_side").over(same)))
    place = F.row_number().over(Window.partitionBy(*keys, "_exact", "_side").orderBy("_rid"))
    rows = rows.withColumn("_label", F.when(F.col("_exact"), F.col("_print")).otherwise(F.lit(b""))).withColumn(
        "_place", F.when(F.col("_exact"), F.col("_nth")).otherwise(place)
    )
    return _partners(rows, Window.partitionBy(*keys, "_exact", "_label", "_place"), keys)


def pair_lines(source: DataFrame, target: DataFrame, layout: Layout, settings: Settings = DEFAULTS) -> DataFrame:
    """Pair every line once: identical lines inside a key first, the others by position."""
    hot = find_hot_keys(source, target, layout, settings)
    if hot is None:
        return _pair_by_key(source, target, layout)
    full = identical_lines(source, target, layout, hot, settings)
    paired = F.col("src").isNotNull() & F.col("tgt").isNotNull()
    return full.where(paired).unionByName(leftover_lines(full.where(~paired), layout, hot, settings))


def compare_lines(
    source: DataFrame, target: DataFrame, keys: list[str], date: str | None = None, settings: Settings = DEFAULTS
) -> Comparison:
    """Compare two normalised tables with ordinals `_rid` line by line."""
    layout = layout_of(data_columns(source), data_columns(target), keys, date)
    rows = compare_pairs(pair_lines(source, target, layout, settings), layout)
    rows = rows.withColumn("confidence", F.lit(None).cast("double"))
    return Comparison(rows, source, target, layout, "transactional")


def amount_column(source: list[str], target: list[str], words: tuple = AMOUNT_WORDS) -> str | None:
    """First source column whose name sounds like money and that the target has too."""
    return next((c for c in source if any(w in c.lower() for w in words) and c in target), None)


def invoice_summary(source: DataFrame, target: DataFrame, column: str) -> DataFrame:
    """Total of the amount column on both sides and the difference; unreadable amounts are left out."""

    def total(df: DataFrame, name: str) -> DataFrame:
        text = F.trim(F.translate(F.col(f"`{column}`"), "$,", ""))
        return df.agg(F.coalesce(F.sum(text.try_cast("decimal(18,2)")), F.lit(0)).cast("decimal(28,2)").alias(name))

    s = total(source, "total").select(F.lit("source").alias("side"), "total")
    t = total(target, "total").select(F.lit("target").alias("side"), "total")
    return s.unionByName(t).agg(
        F.lit(column).alias("amount_column"),
        F.max(F.when(F.col("side") == "source", F.col("total"))).alias("source_invoice_total"),
        F.max(F.when(F.col("side") == "target", F.col("total"))).alias("target_invoice_total"),
    ).withColumn("invoice_difference", F.col("source_invoice_total") - F.col("target_invoice_total"))
