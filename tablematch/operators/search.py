"""Searching, filtering and paging of result tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tablematch.config import DEFAULTS, Settings
from tablematch.sources.ordinal import with_ordinal_by


@dataclass
class Page:
    items: DataFrame
    page: int
    page_size: int
    total: int
    total_pages: int


def search_any(df: DataFrame, text: str | None) -> DataFrame:
    """Rows in which any cell contains the text, ignoring case."""
    wanted = (text or "").strip().lower()
    if not wanted:
        return df
    cells = F.array(*[F.lower(F.col(f"`{c}`").cast("string")) for c in df.columns if c != "_rid"])
    return df.where(F.exists(cells, lambda x: F.coalesce(x.contains(wanted), F.lit(False))))


def snap_page_size(size, settings: Settings = DEFAULTS) -> int:
    """Nearest offered page size; the default for anything that is not a number."""
    try:
        wanted = int(size)
    except (TypeError, ValueError):
        return settings.page_size
    return min(settings.page_sizes, key=lambda s: (abs(s - wanted), s))


def paginate(
    df: DataFrame, page: int = 1, page_size: int | None = None, sort_by: str | None = None, descending: bool = False,
    text: str | None = None, settings: Settings = DEFAULTS, rows: int | None = None,
) -> Page:
    """Filter, sort (nulls last ascending, first descending; ties in row order), one page. Needs `_rid`. `rows`: the number of
    rows of `df` where it is known, so that a page without a filter does not count them.

    An early page is a top-n. For a deep one, whose top-n would gather every earlier row in one place, the sorted
    table is written once and the page is a range of positions in it.
    """
    found = search_any(df, text)
    size = snap_page_size(page_size, settings)
    total = found.count() if rows is None or found is not df else rows
    pages = max(1, -(-total // size))
    page = min(max(1, int(page or 1)), pages)
    order = [F.col("_rid")]
    if sort_by:
        order.insert(0, F.col(sort_by).desc_nulls_first() if descending else F.col(sort_by).asc_nulls_last())
    start = (page - 1) * size
    if start + size <= settings.top_rows:
        items = found.orderBy(*order).offset(start).limit(size)
    else:
        placed = with_ordinal_by(found, order, "_place")
        items = placed.where((F.col("_place") >= start) & (F.col("_place") < start + size)).drop("_place")
    return Page(items, page, size, total, pages)


def amount_mismatches(
    groups: DataFrame, preset: str | None = None, low: float | None = None, high: float | None = None, text: str = "",
    floor: float = 0.01,
) -> DataFrame:
    """Ledger groups whose amounts differ by more than `floor`, by size preset, range and text."""
    gap = F.abs(F.coalesce(F.col("Amount_Source"), F.lit(0)) - F.coalesce(F.col("Amount_Target"), F.lit(0)))
    out = groups.withColumn("gap", gap.cast("decimal(28,2)")).where(F.col("gap") > floor)
    if preset == "high":
        out = out.where(F.col("gap") >= 10000)
    if preset == "low":
        out = out.where(F.col("gap") <= 1000)
    if low is not None:
        out = out.where(F.col("gap") >= low)
    if high is not None:
        out = out.where(F.col("gap") <= high)
    wanted = (text or "").strip().lower()
    if wanted:
        fields = ["TxnNumber_Source", "TxnNumber_Target", "Customer_Source", "Customer_Target"]
        out = out.where(F.lower(F.concat_ws("\n", *fields)).contains(wanted))
    return out


def filter_runs(runs: DataFrame, last: int | None = None, run: str = "") -> DataFrame:
    """Runs (run_no, run_id, …): the last n, or those whose id or number is the wanted one (R1, run 1, 1)."""
    wanted = (run or "").strip().lower()
    if wanted:
        clean = re.sub(r"[^a-z0-9]", "", wanted)
        number = re.sub(r"^(recon|run|r)", "", clean)
        mine = F.regexp_replace(F.lower("run_id"), "[^a-z0-9]", "")
        bare = F.regexp_replace(mine, "^(recon|run|r)", "")
        test = (F.lower("run_id") == wanted) | (mine == clean)
        if number:
            test = test | (bare == number) | (F.col("run_no").cast("string") == number)
        return runs.where(test)
    if last is not None:
        return runs.orderBy(F.desc("run_no")).limit(max(1, last))
    return runs
