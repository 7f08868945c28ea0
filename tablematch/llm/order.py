"""Places in a total order, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tablematch.plans.skew import durable, release

_INSIDE = (1 << 33) - 1


def numbered(df: DataFrame, groups: list[str], order: list[str], out: str) -> DataFrame:
    """`df` with the place `out` (long, from 0) of each row in its group by `order`, nulls first; without groups, among all
    rows. Rows equal in group and order are numbered in any order, so give an order that tells rows apart that matter.

    One range sort deals groups and rows out evenly, a group of any size over many tasks. Each task numbers its rows as
    it writes them; the places follow from the counts of the tasks before, one row per task and group."""
    keys = [*groups, *order]
    spread = durable(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_seq", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_seq", 33), F.col("_seq").bitwiseAND(F.lit(_INSIDE))
    runs = spread.groupBy(*groups, part.alias("_part")).agg(F.min(inside).alias("_least"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = durable(runs.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], "_part", "_least", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    same = part == runs["_part"]
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(runs[f"_g{i}"])
    placed = durable(spread.join(runs, same).select(*df.columns, (inside - F.col("_least") + F.col("_before")).alias(out)))
    release(spread, runs)
    return placed
