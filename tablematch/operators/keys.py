"""Keys of several columns: all least sets of columns that tell the rows of a table apart.

Sets are searched level by level, one column more at each. A set is not looked at if a part of it is a key already, or if its columns
cannot have enough values between them. Sketches then drop the sets with far fewer distinct values than rows, all of a
level in one pass. Only the sets left are grouped exactly, and only on the rows that a part of them leaves together: what a set has
already told apart stays apart, so that these rows grow fewer from level to level.
"""

from __future__ import annotations

from itertools import combinations
from math import prod

from pyspark.sql import DataFrame, functions as F

from tablematch.operators.clean import data_columns
from tablematch.plans.skew import durable, release

#: Sets whose estimated number of distinct values is below this part of the rows are no keys: five times the error of the estimate.
CERTAIN = 0.75
#: Sets that one pass estimates, and the part of the rows up to which what a set leaves together is kept as a table.
AT_ONCE, KEPT = 200, 0.5


def _candidates(failed: list[frozenset[str]], columns: list[str], size: int) -> list[tuple[str, ...]]:
    """Sets of `size` columns all of whose parts of one column less are known not to be keys."""
    known = set(failed)
    grown = {s | {c} for s in known for c in columns if c not in s}
    order = {c: i for i, c in enumerate(columns)}
    whole = [s for s in grown if len(s) == size and all(s - {c} in known for c in s)]
    return sorted((tuple(sorted(s, key=order.__getitem__)) for s in whole), key=lambda s: [order[c] for c in s])


class KeySearch:
    """The search over one table. `keys` lists the sets found, `checked` how many rows were grouped for each set."""

    def __init__(self, df: DataFrame, columns: list[str] | None = None, max_size: int = 3):
        names = columns or data_columns(df)
        filled = [F.count_if(F.trim(F.col(f"`{c}`").cast("string")) != "").alias(f"f{i}") for i, c in enumerate(names)]
        row = df.agg(F.count(F.lit(1)).alias("n"), *filled).first()
        self.n: int = row["n"]
        #: only full columns can be parts of a key
        self.columns = [c for i, c in enumerate(names) if row[f"f{i}"] == self.n]
        self._at = {c: f"c{i}" for i, c in enumerate(self.columns)}
        self.table = df.select(*[F.col(f"`{c}`").alias(a) for c, a in self._at.items()])
        self.keys: list[tuple[str, ...]] = []
        self.checked: dict[tuple[str, ...], int] = {}
        self._left: dict[frozenset[str], tuple[DataFrame, int]] = {}
        try:
            self._search(max_size)
        finally:
            release(*[t for t, _ in self._left.values()])

    def _search(self, max_size: int) -> None:
        if not self.n or not self.columns:
            return
        if self.n == 1:
            self.keys = [(c,) for c in self.columns]
            return
        level, single = [(c,) for c in self.columns], {}
        for size in range(1, max_size + 1):
            # a set has at most as many values as its columns have combinations, by counts with a margin
            possible = [s for s in level if size == 1 or prod(single[c] for c in s) >= self.n]
            found = self._estimates(possible)
            if size == 1:
                single = {s[0]: max(1.0, found[s] / CERTAIN) for s in possible}
            failed = [frozenset(s) for s in level if s not in found or found[s] < CERTAIN * self.n]
            for s in possible:
                if found[s] >= CERTAIN * self.n:
                    if self._is_key(s):
                        self.keys.append(s)
                    else:
                        failed.append(frozenset(s))
            level = _candidates(failed, self.columns, size + 1)
            if not level:
                break

    def _estimates(self, sets: list[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
        """Estimated distinct values of each set, many sets in one pass without a shuffle of rows."""
        out = {}
        for i in range(0, len(sets), AT_ONCE):
            some = sets[i:i + AT_ONCE]
            row = self.table.agg(*[F.approx_count_distinct(F.xxhash64(*[self._at[c] for c in s])).alias(str(k)) for k, s in enumerate(some)]).first()
            out.update({s: row[k] for k, s in enumerate(some)})
        return out

    def _is_key(self, s: tuple[str, ...]) -> bool:
        """Group the rows that the best known part of `s` leaves together by `s`; keep those that it leaves together itself."""
        parts = [self._left[frozenset(p)] for k in range(1, len(s)) for p in combinations(s, k) if frozenset(p) in self._left]
        rows, n = min(parts, key=lambda x: x[1], default=(self.table, self.n))
        self.checked[s] = n
        names = [self._at[c] for c in s]
        groups = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        again = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if again and again <= KEPT * self.n:
            self._left[frozenset(s)] = (durable(rows.join(groups.drop("n"), names, "left_semi")), again)
        return not again


def composite_keys(df: DataFrame, columns: list[str] | None = None, max_size: int = 3) -> DataFrame:
    """(key_columns, size): all least sets of up to `max_size` of the columns on which no two rows of `df` agree, the smallest
    first, in the order of the columns. Columns with nulls or blank cells take no part. A table of one row has each
    such column as a key; an empty one has none."""
    found = KeySearch(df, columns, max_size).keys
    return df.sparkSession.createDataFrame([(list(s), len(s)) for s in found], "key_columns array<string>, size int")


def suggested_keys(df: DataFrame, columns: list[str] | None = None, max_size: int = 3) -> list[str]:
    """The smallest key, of equal ones that of the earliest columns; none if there is none of that size."""
    return list(next(iter(KeySearch(df, columns, max_size).keys), ()))
