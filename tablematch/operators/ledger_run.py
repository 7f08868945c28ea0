"""A ledger comparison from two raw grids to the buckets of its result and their pages."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from tablematch.config import DEFAULTS, Settings
from tablematch.operators.align import Mapped, load_and_map
from tablematch.operators.ledger import Ledger, compare_ledger
from tablematch.operators.search import Page, paginate
from tablematch.plans.skew import durable, release
from tablematch.sources.ordinal import with_ordinal_by
from tablematch.vocabulary import default_vocabulary

#: Fields without which nothing can be compared.
REQUIRED = ("TxnNumber", "Amount")

# Names of the buckets and the statuses of their rows.
STATUSES = {
    "matched": ("Matched",), "disputed": ("Amount Mismatch",), "unmatched_source": ("Only In Source",),
    "unmatched_target": ("Only In Target",), "tier2_rows": ("Tier2 Match", "Tier2 Amount Mismatch"),
}
#: The line counts of the groups that tell how many rows share a key.
LINES = {"duplicate_source_rows": "Lines_Source", "duplicate_target_rows": "Lines_Target"}


class FieldsNotMapped(ValueError):
    """Required fields that no column of a side stands for, with the decisions on all fields."""

    def __init__(self, missing: dict[str, list[str]], mappings: dict[str, list[Mapped]]):
        super().__init__("required fields are not mapped: " + ", ".join(f"{side} {f}" for side, fields in missing.items() for f in fields))
        self.missing, self.mappings = missing, mappings


@dataclass
class LedgerRun:
    """Result of `compare_grids`: the comparison, how each side was mapped, and the rows of each bucket (with `_rid`)."""

    ledger: Ledger
    mappings: dict[str, list[Mapped]]
    buckets: dict[str, DataFrame]

    @cached_property
    def group_totals(self) -> dict[str, int]:
        """Totals of the buckets that the groups tell, in one pass. Each key of a side is in one group, with the number of its
        lines, so the groups of several lines add up to the duplicate rows."""
        sizes = {b: F.count_if(F.col("MatchStatus").isin(*names)) for b, names in STATUSES.items()}
        sizes |= {b: F.coalesce(F.sum(F.when(F.col(n) > 1, F.col(n))), F.lit(0)) for b, n in LINES.items()}
        return self.ledger.groups.agg(*[n.alias(b) for b, n in sizes.items()]).first().asDict()

    def totals(self) -> DataFrame:
        """(bucket, total) of all buckets; those that the groups tell in one pass."""
        known = self.group_totals
        out = self.ledger.groups.sparkSession.createDataFrame(list(known.items()), "bucket string, total long")
        for name, rows in self.buckets.items():
            if name not in known:
                out = out.unionByName(rows.agg(F.count(F.lit(1)).alias("total")).select(F.lit(name).alias("bucket"), "total"))
        return out

    def page(self, bucket: str, page: int = 1, page_size: int | None = None, sort_by: str | None = None, descending: bool = False, text: str | None = None) -> Page:
        """One page of a bucket, searched and sorted; without `sort_by` in order of the numbers."""
        if bucket not in self.buckets:
            raise KeyError(f"no bucket {bucket!r}; there are {', '.join(self.buckets)}")
        rows = self.group_totals[bucket] if not text and bucket in {**STATUSES, **LINES} else None
        return paginate(self.buckets[bucket], page, page_size, sort_by, descending, text, rows=rows)


def compare_grids(
    source: DataFrame, target: DataFrame, fields: dict[str, list[str]] | None = None, source_overrides: dict[str, str] | None = None,
    target_overrides: dict[str, str] | None = None, method: str = "exact", settings: Settings = DEFAULTS,
) -> LedgerRun:
    """Two raw grids (`read_grid`, `read_workbook`) to buckets: each side is mapped by itself onto the canonical fields, then both are
    compared. A required field that a side lacks, or that several columns could stand for, ends the run with the decisions.

    Header, mapping, comparison and buckets each read a side again, so the grid and the mapped table are written once instead of
    parsed each time. The groups are put in order of their numbers once, so that a page of a bucket without a sort is a filter, and
    counted once for the totals of all pages."""
    fields = fields or default_vocabulary()["transactional"]
    tables, mappings, grids = {}, {}, []
    for side, grid, overrides in (("source", source, source_overrides), ("target", target, target_overrides)):
        grids.append(durable(grid))
        tables[side], mappings[side] = load_and_map(grids[-1], fields, overrides, method, settings)
    missing = {side: [m.field for m in found if m.field in REQUIRED and m.status != "MAPPED"] for side, found in mappings.items()}
    if any(missing.values()):
        raise FieldsNotMapped({side: m for side, m in missing.items() if m}, mappings)
    for name in ("TxnType", "TxnDate", "Customer"):
        kind = "date" if name == "TxnDate" else "string"
        tables = {side: t if name in t.columns else t.withColumn(name, F.lit(None).cast(kind)) for side, t in tables.items()}
    tables = {side: durable(t) for side, t in tables.items()}
    release(*grids)
    ledger = compare_ledger(tables["source"], tables["target"], settings)
    order = [F.coalesce("TxnNumber_Source", "TxnNumber_Target"), "TxnType", "MatchStatus", "TxnNumber_Target"]
    groups, ledger.groups = ledger.groups, with_ordinal_by(ledger.groups, order)
    release(groups)
    buckets = {name: ledger.groups.where(F.col("MatchStatus").isin(*statuses)) for name, statuses in STATUSES.items()}
    buckets |= {
        "duplicate_source_rows": ledger.duplicates_source, "duplicate_target_rows": ledger.duplicates_target,
        "source_exceptions": ledger.exceptions_source, "target_exceptions": ledger.exceptions_target,
    }
    return LedgerRun(ledger, mappings, buckets)
