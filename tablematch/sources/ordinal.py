"""Row ordinals: the position of a row in its input, as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablematch.plans.skew import durable

_LOW_33_BITS = (1 << 33) - 1


def with_ordinal(scan: DataFrame, out: str = "_rid", numbered: bool = False) -> DataFrame:
    """Add the 0-based file-order position of each row to a plain file scan. Files come in order of their names;
    `numbered`: of one write, whose names grow longer as their numbers do.

    Splits are packed into tasks by size, so task order is not file order. Rows are counted per (file, split start);
    a running sum over the splits gives each split's offset. Only that small per-split table is ordered globally, and
    it goes to the rows, so that they are not shuffled.
    """
    tagged, offsets = _tagged(scan), _offsets(_tagged(scan), numbered)
    return _numbered(tagged, F.broadcast(offsets), out)


def _tagged(scan: DataFrame) -> DataFrame:
    names = [c for c in scan.columns if c != "_metadata"]
    return scan.select(
        *names,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_33_BITS)).alias("_inside"),
    )


def _offsets(tagged: DataFrame, numbered: bool) -> DataFrame:
    """(_file, _start, _low, _offset): how many rows come before each split, and the number its first row has in its task."""
    splits = tagged.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_inside").alias("_low"))
    names_order = [F.length("_file"), "_file"] if numbered else ["_file"]
    earlier = Window.orderBy(*names_order, "_start").rowsBetween(Window.unboundedPreceding, -1)
    return splits.select("_file", "_start", "_low", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))


def _numbered(tagged: DataFrame, offsets: DataFrame, out: str) -> DataFrame:
    names = [c for c in tagged.columns if c not in ("_file", "_start", "_inside")]
    return tagged.join(offsets, ["_file", "_start"]).select(
        *names, (F.col("_offset") + F.col("_inside") - F.col("_low")).alias(out)
    )


def with_ordinal_by(df: DataFrame, order: list[str | Column], out: str = "_rid", keep: list[str | Column] | None = None) -> DataFrame:
    """Add the 0-based position of each row in `order`; with `keep` only these columns stay. The sorted table is written once,
    because two runs of a range sort may choose different partition bounds; its file order is the sort order. Its splits
    are counted once, however often the result is read."""
    ordered = df.orderBy(*order)
    tagged = _tagged(durable(ordered.select(*keep) if keep else ordered))
    return _numbered(tagged, F.broadcast(durable(_offsets(tagged, numbered=True))), out)


def internal_id(prefix: str, rid: str = "_rid") -> Column:
    """Technical id of a row, such as SRC_0."""
    return F.concat(F.lit(f"{prefix}_"), F.col(rid).cast("string"))
