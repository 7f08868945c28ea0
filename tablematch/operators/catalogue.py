"""Which columns of many tables hold the same values: sketches first, exact counts only where two columns can overlap.

The sketch of a column is its least value hashes. Sketches of parts of a column, or of the versions of a table, merge into
that of the whole without reading data. Two columns of which a tenth of all values is shared have none of the least 256 hashes in
common with a chance of 2e-12, so the pairs that share a hash are the only ones whose values are compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablematch.operators.clean import data_columns
from tablematch.plans.assign import assign_columns
from tablematch.plans.skew import durable

#: Hashes kept of a column.
SKETCH = 256
_SCHEMA = "table_name string, pos int, column_name string, filled long, complete boolean, hashes array<long>"


def _text(name: str) -> Column:
    return F.trim(F.col(f"`{name}`").cast("string"))


def sketch_columns(table_name: str, df: DataFrame, k: int = SKETCH) -> DataFrame:
    """(table_name, pos, column_name, filled, complete, hashes): of each column the number of its non-null cells and the `k`
    least hashes of its trimmed values, in order; `complete` if these are all. A column without values has none.

    A first pass estimates the distinct values of each column. With that the second one lets only hashes through that may be
    among the least: about 2 k per column are shuffled, however long the table, in place of its values."""
    names = data_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], _SCHEMA)
    hashes = [F.xxhash64(_text(c)) for c in names]
    found = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(names)], *[F.approx_count_distinct(h).alias(f"d{i}") for i, h in enumerate(hashes)]).first()
    cells = []
    for i, (c, h) in enumerate(zip(names, hashes)):
        distinct = found[f"d{i}"]
        # hashes are even over the longs; half as many again as are needed, and the error of the estimate, lie below the limit
        limit = (1 << 63) - 1 if distinct <= 4 * k else -(1 << 63) + int((1 << 64) * 2 * k / distinct)
        cells.append(F.when(F.col(f"`{c}`").isNotNull() & (h <= F.lit(limit)), F.struct(F.lit(i).alias("pos"), h.alias("hash"))))
    low = df.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*").distinct()
    ranked = low.withColumn("place", F.row_number().over(Window.partitionBy("pos").orderBy("hash"))).where(F.col("place") <= k + 1)
    least = ranked.groupBy("pos").agg(F.array_sort(F.collect_list("hash")).alias("all"))
    frame = df.sparkSession.createDataFrame([(table_name, i, c, found[f"n{i}"]) for i, c in enumerate(names)], "table_name string, pos int, column_name string, filled long")
    kept = F.coalesce("all", F.array().cast("array<long>"))
    return frame.join(F.broadcast(least), "pos", "left").select(  # as many rows as columns
        "table_name", "pos", "column_name", "filled", (F.size(kept) <= k).alias("complete"), F.slice(kept, 1, k).alias("hashes"),
    )


def merge_sketches(sketches: DataFrame, k: int = SKETCH) -> DataFrame:
    """One sketch per table and column from those of its parts or versions."""
    merged = F.array_sort(F.array_distinct(F.flatten(F.collect_list("hashes"))))
    by = sketches.groupBy("table_name", "column_name").agg(
        F.min("pos").alias("pos"), F.sum("filled").alias("filled"), F.every("complete").alias("parts"), merged.alias("hashes")
    )
    return by.select("table_name", "pos", "column_name", "filled", (F.col("parts") & (F.size("hashes") <= k)).alias("complete"), F.slice("hashes", 1, k).alias("hashes"))


def store_sketches(sketches: DataFrame, path: str, version: int) -> None:
    """Write the sketches of one version of the tables; writing it again replaces it."""
    rows = sketches.withColumn("version", F.lit(version))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def stored_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SCHEMA + ", version int").parquet(path)


def overlap_candidates(sketches: DataFrame) -> DataFrame:
    """(table_a, column_a, table_b, column_b, estimate): the pairs of columns of two tables that share a hash, each once, and
    the estimated part of their values that both have. Columns meet on hashes only; no pair without one is made."""
    own = sketches.select("table_name", "column_name", F.explode("hashes").alias("hash"))
    other = own.toDF("table_b", "column_b", "hash")
    pairs = own.toDF("table_a", "column_a", "hash").join(other, "hash").where("table_a < table_b").drop("hash").distinct()
    side = sketches.select("table_name", "column_name", "hashes", "complete")
    both = pairs.join(side.toDF("table_a", "column_a", "a", "a_whole"), ["table_a", "column_a"]).join(side.toDF("table_b", "column_b", "b", "b_whole"), ["table_b", "column_b"])
    union, size = F.array_sort(F.array_union("a", "b")), F.greatest(F.size("a"), F.size("b"))
    seen = F.when(F.col("a_whole") & F.col("b_whole"), union).otherwise(F.slice(union, F.lit(1), size))
    shared = F.size(F.array_intersect(seen, F.array_intersect("a", "b")))
    return both.select("table_a", "column_a", "table_b", "column_b", (shared / F.size(seen)).alias("estimate"))


def catalogue_overlaps(tables: dict[str, DataFrame], least: float = 0.1, k: int = SKETCH, sketches: DataFrame | None = None) -> DataFrame:
    """(table_a, pos_a, column_a, table_b, pos_b, column_b, shared, overlap): all pairs of columns of two tables of whose
    distinct trimmed values together a part of `least` or more stands in both; `sketches` may come from a store.

    Exact for the pairs that the sketches let through. Only columns of such pairs are read, as hashes of 128 bits: their
    sets of columns are grouped by value, and then counted by set, so that a value moves once, whatever the number of
    pairs. Nulls are no values. No tables or no shared values give no rows."""
    if not tables:
        raise ValueError("a catalogue has one table at least")
    if sketches is None:
        sketches = durable(reduce(DataFrame.union, [sketch_columns(name, df, k) for name, df in tables.items()]))
    spark = sketches.sparkSession
    # as many rows as there are pairs of columns that can overlap: the schemas bound them, not the data
    pairs = [tuple(r)[:4] for r in overlap_candidates(sketches).collect()]
    columns = sorted({p[:2] for p in pairs} | {p[2:] for p in pairs})
    number = {c: i for i, c in enumerate(columns)}
    pos = {(t, c): i for t, df in tables.items() for i, c in enumerate(data_columns(df))}
    fields = "a int, b int, table_a string, pos_a int, column_a string, table_b string, pos_b int, column_b string"
    listed = spark.createDataFrame([(number[p[:2]], number[p[2:]], p[0], pos[p[:2]], p[1], p[2], pos[p[2:]], p[3]) for p in pairs], fields)
    if not pairs:
        return listed.drop("a", "b").withColumn("shared", F.lit(0).cast("long")).withColumn("overlap", F.lit(0.0))
    cells = []
    for name, df in tables.items():
        wanted = [c for c in data_columns(df) if (name, c) in number]
        if wanted:
            each = [F.when(F.col(f"`{c}`").isNotNull(), F.struct(F.lit(number[name, c]).alias("column"), F.xxhash64(_text(c)).alias("h"), F.xxhash64(F.lit(1), _text(c)).alias("g"))) for c in wanted]
            cells.append(df.select(F.explode(F.array_compact(F.array(*each))).alias("x")).select("x.*"))
    values = reduce(DataFrame.union, cells).groupBy("h", "g").agg(F.array_sort(F.collect_set("column")).alias("columns"))
    sets = durable(values.groupBy("columns").agg(F.count(F.lit(1)).alias("n")))
    sizes = sets.select(F.explode("columns").alias("column"), "n").groupBy("column").agg(F.sum("n").alias("size"))
    two = sets.select(F.explode("columns").alias("a"), "columns", "n").select("a", F.explode("columns").alias("b"), "n").where("a < b")
    # a pair is listed by table name; numbers follow the same order
    shared = two.groupBy("a", "b").agg(F.sum("n").alias("shared"))
    found = listed.join(shared, ["a", "b"]).join(sizes.toDF("a", "size_a"), "a").join(sizes.toDF("b", "size_b"), "b")
    found = found.withColumn("overlap", F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared")))
    return found.where(F.col("overlap") >= least).select("table_a", "pos_a", "column_a", "table_b", "pos_b", "column_b", "shared", "overlap")


def assign_by_overlap(overlaps: DataFrame) -> DataFrame:
    """(table_a, table_b, column_a, column_b, overlap): for each two tables the one-to-one choice of column pairs with the
    largest sum of overlaps, each to four digits. Every pair of tables is a matrix of its own, as large as the two schemas."""
    pair = F.concat_ws("\x1f", "table_a", "table_b")
    scored = durable(overlaps.withColumn("pair_id", pair).withColumn("score", F.round(F.col("overlap") * 10_000)))
    chosen = assign_columns(scored.select("pair_id", F.col("pos_a").alias("source_pos"), F.col("pos_b").alias("target_pos"), "score"))
    on = (scored["pair_id"] == chosen["pair_id"]) & (scored["pos_a"] == chosen["source_pos"]) & (scored["pos_b"] == chosen["target_pos"])
    return scored.join(chosen, on).select("table_a", "table_b", "column_a", "column_b", "overlap", F.col("score").cast("long").alias("score"))
