"""Delimited records whose quoted cells hold line breaks, read in many tasks.

Whether a split of a file begins inside a quoted cell is not known to the task that reads it. So each split is first read for
both cases: in which state it ends, and how many records begin in it. These functions of the state are composed over the
splits of a file, as counts are for row ordinals. Then the splits are cut into records; what stands before the first
and after the last record end of a split is joined over the borders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablematch.plans.skew import durable, release

OUTSIDE, INSIDE = 0, 1
HEAD, RECORD, TAIL = 0, 1, 2


class Quotes:
    """How a line changes the state. A quote opens a cell at its beginning only; inside, a doubled quote is a quote. What
    stands between a closing quote and the separator is text."""

    def __init__(self, sep: str = ","):
        s = re.escape(sep).encode()
        self.cells = re.compile(rb'(?:(?:"[^"]*+(?:""[^"]*+)*+"[^' + s + rb']*+|(?!")[^' + s + rb"]*+)" + s + rb")*+")
        self.rest = re.compile(rb'[^"]*+(?:""[^"]*+)*+"[^' + s + rb"]*+(?:" + s + rb"|\Z)")
        self.whole = re.compile(rb'"[^"]*+(?:""[^"]*+)*+"')

    def after(self, line: bytes, state: int) -> int:
        """The state at the end of a line that begins in `state`."""
        place = 0
        if state == INSIDE:
            closed = self.rest.match(line)
            if not closed:
                return INSIDE
            place = closed.end()
        place = self.cells.match(line, place).end()
        return INSIDE if line[place:place + 1] == b'"' and not self.whole.match(line, place) else OUTSIDE

    def states(self, values: pa.Array, state: int) -> list[int]:
        """The state after each line; lines without quotes keep it."""
        quoted = pc.indices_nonzero(pc.count_substring(values, '"')).to_pylist()
        out, done = [], 0
        for i in quoted:
            out += [state] * (i - done)
            state = self.after(values[i].as_py(), state)
            out.append(state)
            done = i + 1
        return out + [state] * (len(values) - done)


def _scan(spark: SparkSession, path: str) -> DataFrame:
    scan = spark.read.option("lineSep", "\n").text(path)
    return scan.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array]]:
    """(file, start, lines): the stretches of one split in each batch; a task may read several splits, one after the other."""
    for batch in batches:
        ends = pc.run_end_encode(batch["start"]).run_ends.to_pylist()
        names = pc.run_end_encode(batch["file"]).run_ends.to_pylist()
        cuts = [0, *sorted({*ends, *names})]
        for a, b in zip(cuts, cuts[1:]):
            yield batch["file"][a].as_py(), batch["start"][a].as_py(), batch["value"].slice(a, b - a)


def _table(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _splits(scan: DataFrame, quotes: Quotes) -> DataFrame:
    """(file, start, out0, out1, n0, n1, cr) of each split: the state at its end and the number of records that begin in it,
    if it begins outside or inside quotes, and if a carriage return ends its first line. Empty lines are no records."""
    fields = [("file", pa.string()), *[(c, pa.int64()) for c in ("start", "out0", "out1", "n0", "n1", "cr")]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun, cr = None, [], [], 0
        for file, start, values in _runs(batches):
            if now != (file, start):
                if now:
                    yield _table([(*now, *state, *begun, cr)], fields)
                now, state, begun, cr = (file, start), [OUTSIDE, INSIDE], [0, 0], int(values[0].as_py().endswith(b"\r"))
            sizes = pc.binary_length(values)
            empty = pc.or_(pc.equal(sizes, 0), pc.equal(values, b"\r")).to_pylist()
            for k in (OUTSIDE, INSIDE):
                after = quotes.states(values, state[k])
                # a line begins a record if the one before ended one, and it is not empty
                ended = [state[k] == OUTSIDE, *[s == OUTSIDE for s in after[:-1]]]
                begun[k] += sum(e and not x for e, x in zip(ended, empty))
                state[k] = after[-1] if after else state[k]
        if now:
            yield _table([(*now, *state, *begun, cr)], fields)

    return scan.mapInArrow(count, "file string, start long, out0 long, out1 long, n0 long, n1 long, cr long")


def _composed(splits: DataFrame) -> DataFrame:
    """`splits` with the state in which each begins, the number of records before it in all and in its file, `heads`, the
    number of files with a record up to it, and `origin`, the split where the record begins that it begins in the middle of.
    One row per split is ordered, no data."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, 0)
    turns = F.coalesce(F.sum(F.when((F.col("out0") == 1) & (F.col("out1") == 0), 1).otherwise(0)).over(before), F.lit(0))
    fixed = F.when(F.col("out0") == F.col("out1"), F.struct(F.col("out0").alias("state"), F.col("turns").alias("turns")))
    known = splits.withColumn("turns", turns).withColumn("fixed", F.last(fixed, ignorenulls=True).over(before))
    known = known.withColumn("state", F.coalesce((F.col("fixed.state") + F.col("turns") - F.col("fixed.turns")), F.col("turns")) % 2)
    known = known.withColumn("n", F.when(F.col("state") == OUTSIDE, F.col("n0")).otherwise(F.col("n1")))
    known = known.withColumn("in_file", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return known.select(
        "file", "start", "state", "n", "in_file", F.sum(F.when((F.col("in_file") == 0) & (F.col("n") > 0), 1).otherwise(0)).over(so_far).alias("heads"), F.last(F.when(F.col("n") > 0, F.col("start")), ignorenulls=True).over(before).alias("origin"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"),
        F.first("cr").over(Window.partitionBy("file").orderBy("start")).alias("crlf"),
    )


def _cut(scan: DataFrame, quotes: Quotes, begins: int) -> DataFrame:
    """(file, start, kind, place, value): the records of each split, if it begins in state `begins`, and its two ends: the
    HEAD of a split that begins inside quotes, and the TAIL that no record end follows."""
    fields = [("file", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("place", pa.int64()), ("value", pa.binary())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, kind, place, held = None, OUTSIDE, RECORD, 0, []

        def rest() -> list[tuple]:
            return [(*now, HEAD if kind == HEAD else TAIL, place, b"\n".join(held))] if now and held else []

        for file, start, values in _runs(batches):
            rows = []
            if now != (file, start):
                rows += rest()
                now, state, place, held = (file, start), begins, 0, []
                kind = HEAD if begins == INSIDE else RECORD
            after = quotes.states(values, state)
            for line, state in zip(values.to_pylist(), after):
                if state == INSIDE:
                    held.append(line)
                    continue
                value = b"\n".join([*held, line]) if held else line
                held = []
                value = value[:-1] if value.endswith(b"\r") else value
                if value or kind == HEAD:
                    rows.append((*now, kind, place, value))
                    place += kind == RECORD
                kind = RECORD
            yield _table(rows, fields)
        yield _table(rest(), fields)

    return scan.mapInArrow(cut, "file string, start long, kind int, place long, value binary")


def read_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(file, rid, first, heads, text): the records of the delimited UTF-8 files under `path`, with their positions in file order;
    `first` marks the first record of each file, and `heads` counts these up to the record. Records end at a line feed outside quotes, of which a carriage return
    before it is part. Line breaks inside quotes stay as they are, but in a file whose first line ends with both, both together
    are one line feed. Empty lines are no records. A quote that is never closed
    holds the rest of its file. A file of any size is read split by split; only the two ends of a split meet others."""
    quotes = Quotes(sep)
    splits = durable(_composed(_splits(_scan(spark, path), quotes)))
    parts = []
    for state in (OUTSIDE, INSIDE):
        here = splits.where(F.col("state") == state)
        if state == OUTSIDE or not here.isEmpty():
            # both reads must be cut at the same bytes; rows of a split that the first did not see end with an error
            cut = _cut(_scan(spark, path), quotes, state).join(splits.drop("n"), ["file", "start"], "left")
            checked = F.coalesce("state", F.raise_error(F.lit("the splits of a file changed while it was read")).cast("long"))
            parts.append(durable(cut.withColumn("state", checked).where(F.col("state") == state)))
    pieces = reduce(DataFrame.union, parts)
    whole = pieces.where(F.col("kind") == RECORD).select("file", "offset", "in_file", "heads", "crlf", "place", "value")
    ends = pieces.where(F.col("kind") != RECORD).select(
        "file", F.when(F.col("kind") == TAIL, F.col("start")).otherwise(F.col("origin")).alias("origin"), "start", "value",
        *[F.when(F.col("kind") == TAIL, F.col(c)).alias(c) for c in ("offset", "in_file", "heads", "crlf", "place")],
    )
    # one record at most begins in a split and ends in another
    parts = F.transform(F.sort_array(F.collect_list(F.struct("start", "value"))), lambda p: F.hex(p["value"]))
    known = [F.max(c).alias(c) for c in ("offset", "in_file", "heads", "crlf", "place")]
    joined = ends.groupBy("file", "origin").agg(F.unhex(F.array_join(parts, "0A")).alias("value"), *known)
    rows = whole.union(joined.select(*whole.columns))
    release(splits)
    text = F.col("value").cast("string")
    return rows.select(
        "file", (F.col("offset") + F.col("place")).alias("rid"), (F.col("in_file") + F.col("place") == 0).alias("first"), "heads",
        F.when(F.col("crlf") == 1, F.replace(text, F.lit("\r\n"), F.lit("\n"))).otherwise(text).alias("text"),
    )


def cells(record: Column, n: int, sep: str = ",", strict: bool = False) -> Column:
    """Struct of the text cells `_c0` ... of a record."""
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "mode": "FAILFAST" if strict else "PERMISSIVE"}
    return F.from_csv(record, ", ".join(f"_c{i} string" for i in range(n)), options)


def first_cells(records: DataFrame, sep: str = ",") -> list[str | None]:
    """Cells of the first record, which say how many columns there are; none without records."""
    top = records.orderBy("rid").select("text").first()
    if top is None:
        return []
    row = records.sparkSession.createDataFrame([tuple(top)], "text string")
    return list(row.select(cells(F.col("text"), _width(top["text"], sep), sep).alias("r")).first()["r"])


def _width(record: str, sep: str) -> int:
    """Number of cells of a record."""
    quoted = re.compile(rf'"[^"]*+(?:""[^"]*+)*+"[^{re.escape(sep)}]*+|[^{re.escape(sep)}]*+')
    n = place = 0
    while True:
        n, place = n + 1, quoted.match(record, place).end()
        if place >= len(record):
            return n
        place += 1
        if place == len(record):
            return n + 1


def column_labels(head: list[str | None]) -> list[str]:
    """Names from a header: `_c<i>` for a cell without text, and the position behind a name that comes twice, whatever the case."""
    lower = [(x or "").lower() for x in head]
    return [f"_c{i}" if not x else f"{x}{i}" if lower.count(x.lower()) > 1 else x for i, x in enumerate(head)]
