"""Master comparison: one record per key; repeated keys are defects; leftovers may be renames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tablematch.config import DEFAULTS, Settings
from tablematch.functions.text import key_text
from tablematch.operators.cells import Layout, compare_pairs, layout_of
from tablematch.operators.clean import data_columns
from tablematch.plans.assign import match_texts
from tablematch.plans.skew import durable, first_rows, group_heads


@dataclass
class Comparison:
    """Result of a comparison. `rows` has one line per pair or one-sided record:
    key columns, src, tgt (structs with `_rid`), status, diffs, row_date, confidence."""

    rows: DataFrame
    source: DataFrame
    target: DataFrame
    layout: Layout
    data_type: str
    duplicates_source: DataFrame | None = None
    duplicates_target: DataFrame | None = None


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of `left` whose key is absent from `right`. The right side is reduced to distinct keys before its
    shuffle; a hot key on the left is split by the skew-join rule."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row, with the group size and the first ordinal."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_rid").alias("first_rid")).where("n > 1")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """All members of the groups that share a key. Group sizes are aggregated and joined back, so no task has to
    hold a group as a window would."""
    return df.join(duplicate_keys(df, keys).select(*keys), keys, "left_semi")


def inner_pairs(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """First row per key of both sides, joined on the key."""
    s, t = first_rows(source, keys), first_rows(target, keys)
    left = s.select(*keys, F.struct(*[c for c in s.columns if c not in keys]).alias("src"))
    right = t.select(*keys, F.struct(*[c for c in t.columns if c not in keys]).alias("tgt"))
    return left.join(right, keys)


def _heads(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    return group_heads(df, keys).select(*keys, F.col("row").alias(side), F.col("n").alias(f"{side}_n"))


def _with_keys(pairs: DataFrame, side: str, keys: list[str], names: list[str]) -> DataFrame:
    """Rebuild the side's struct with the key columns inside."""
    fields = [F.col(k) if k in keys else F.col(side).getField(k).alias(k) for k in [*names, "_rid"]]
    return pairs.withColumn(side, F.when(F.col(side).isNotNull(), F.struct(*fields)))


def one_sided_repeats(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Repeated keys that only one side has, with their first ordinal: one aggregate over the keys of both tables."""
    mine = source.select(*keys, F.lit(1).alias("_s"), F.lit(0).alias("_t"), "_rid")
    theirs = target.select(*keys, F.lit(0).alias("_s"), F.lit(1).alias("_t"), "_rid")
    sizes = mine.unionByName(theirs).groupBy(*keys).agg(
        F.sum("_s").alias("n_s"), F.sum("_t").alias("n_t"), F.min("_rid").alias("first_rid")
    )
    return sizes.where("(n_t = 0 and n_s > 1) or (n_s = 0 and n_t > 1)")


def _surplus(df: DataFrame, repeats: DataFrame, keys: list[str], side: str, names: list[str]) -> DataFrame:
    """Later rows of repeated keys that the other side does not have."""
    wanted = repeats.select(*keys, "first_rid")
    return df.join(wanted, keys).where("_rid <> first_rid").select(*keys, F.struct(*names, "_rid").alias(side))


def compare_master(
    source: DataFrame,
    target: DataFrame,
    keys: list[str],
    date: str | None = None,
    similar: bool = True,
    settings: Settings = DEFAULTS,
) -> Comparison:
    """Compare two normalised tables with ordinals `_rid`.

    Each side is aggregated to its first row and size per key; the two results are already partitioned by key when
    they are joined. Surplus rows of one-sided repeated keys are fetched by a join with those few keys.
    """
    layout = layout_of(data_columns(source), data_columns(target), keys, date)
    joined = _heads(source, keys, "src").join(_heads(target, keys, "tgt"), keys, "full")
    pairs = _with_keys(_with_keys(joined, "src", keys, layout.source), "tgt", keys, layout.target)
    pairs = pairs.select(*keys, "src", "tgt")

    repeats = one_sided_repeats(source, target, keys)
    deleted = _surplus(source, repeats.where("n_t = 0"), keys, "src", layout.source)
    added = _surplus(target, repeats.where("n_s = 0"), keys, "tgt", layout.target)
    pairs = pairs.unionByName(deleted, allowMissingColumns=True).unionByName(added, allowMissingColumns=True)
    rows = compare_pairs(pairs, layout).withColumn("confidence", F.lit(None).cast("double"))
    if similar:
        rows = _rename(rows, layout, settings)
    return Comparison(
        rows, source, target, layout, "master", duplicates(source, keys), duplicates(target, keys)
    )


def _rename(rows: DataFrame, layout: Layout, settings: Settings) -> DataFrame:
    """Pair deleted with added records of similar key text and mark the pairs as Renamed."""
    rows = durable(rows)
    deleted = rows.where("status = 'Deleted'")
    added = rows.where("status = 'Added'")

    def texts(side: DataFrame, struct: str) -> DataFrame:
        cells = [F.col(struct).getField(k) for k in layout.keys]
        return side.select(F.col(struct).getField("_rid").alias("rid"), key_text(cells, " ").alias("text"))

    matches = durable(match_texts(texts(deleted, "src"), texts(added, "tgt"), settings=settings))
    left = deleted.select("src", F.col("src._rid").alias("left_rid"))
    right = added.select("tgt", F.col("tgt._rid").alias("right_rid"))
    renamed = (
        compare_pairs(matches.join(left, "left_rid").join(right, "right_rid"), layout)
        .select(
            *[F.col("tgt").getField(k).alias(k) for k in layout.keys],
            "src", "tgt", F.lit("Renamed").alias("status"), "diffs", "row_date", F.round("score", 4).alias("confidence"),
        )
    )
    kept = rows.where("status not in ('Deleted', 'Added')")
    gone = deleted.join(matches, F.col("src._rid") == F.col("left_rid"), "left_anti")
    new = added.join(matches, F.col("tgt._rid") == F.col("right_rid"), "left_anti")
    return kept.unionByName(renamed).unionByName(gone).unionByName(new)
