"""Scans: delimited files as text, stored versions, named targets, schema-less records."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablematch.config import DEFAULTS, Settings
from tablematch.operators.clean import drop_unnamed
from tablematch.sources import records as rc
from tablematch.sources.ordinal import with_ordinal


def _delimited(spark: SparkSession, header: bool, strict: bool):
    """Text cells; inside quotes, a doubled quote is a quote and commas are text. `strict`: lines with too few or too many
    cells end the read with an error, instead of filling up or cutting off."""
    reader = spark.read.option("header", header).option("inferSchema", False).option("quote", '"').option("escape", '"')
    return reader.option("mode", "FAILFAST" if strict else "PERMISSIVE")


def _quoted(spark: SparkSession, path: str, header: bool, strict: bool) -> DataFrame:
    """The same with line breaks inside quotes: `_rid` and the cells of the records of `read_records`. A header
    stands at the top of each file and is counted in none."""
    found = rc.read_records(spark, path)
    head = rc.first_cells(found)
    names = rc.column_labels(head) if header else [f"_c{i}" for i in range(len(head))]
    body = found.where("NOT first").select((F.col("rid") - F.col("heads")).alias("_rid"), "file", "text") if header else found.select(F.col("rid").alias("_rid"), "file", "text")
    row = body.withColumn("_row", rc.cells(F.col("text"), max(len(head), 1), strict=strict))
    return row.select("_rid", *[F.col("_row")[f"_c{i}"].alias(n) for i, n in enumerate(names)])


def read_strings(
    spark: SparkSession, path: str, settings: Settings = DEFAULTS, ordinal: bool = True, multi_line: bool = False, strict: bool = False,
) -> DataFrame:
    """Delimited file with a header, every column a string; headerless columns with hardly any values are dropped.
    `multi_line`: cells may hold line breaks inside quotes; files are still read in many tasks (`sources.records`)."""
    if multi_line:
        table = _quoted(spark, path, True, strict)
        return drop_unnamed(table if ordinal else table.drop("_rid"), settings)
    scan = _delimited(spark, True, strict).csv(path)
    return drop_unnamed(with_ordinal(scan) if ordinal else scan, settings)


def read_grid(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Delimited file as a raw grid of text cells `_c0 … _cn` with row ordinals; the header is found later."""
    if multi_line:
        return _quoted(spark, path, False, False)
    return with_ordinal(_delimited(spark, False, False).csv(path))


@dataclass
class Targets:
    """Named targets. An entry is a table name, a parquet path, or the options of a JDBC table."""

    entries: dict[str, str | dict] = field(default_factory=dict)
    default: str | None = None

    def resolve(self, name: str | None) -> tuple[str, str | dict]:
        """Entry of a project name, ignoring case and blanks; the default when it is missing or unknown."""
        wanted = (name or "").strip().lower()
        known = {k.strip().lower(): k for k in self.entries}
        key = known.get(wanted, self.default)
        if key is None or key not in self.entries:
            raise KeyError(f"no target named {name!r} and no default target")
        return key, self.entries[key]

    def read(self, spark: SparkSession, name: str | None) -> DataFrame:
        _, entry = self.resolve(name)
        if isinstance(entry, dict):
            missing = {"partitionColumn", "lowerBound", "upperBound", "numPartitions"} - entry.keys()
            if missing:
                raise ValueError(f"a JDBC target is read in parts and needs {', '.join(sorted(missing))}")
            return spark.read.format("jdbc").options(**entry).load()
        if "/" in entry:
            return spark.read.parquet(entry)
        return spark.table(entry)


def record_columns(df: DataFrame, column: str = "row_data", order: str = "_rid") -> DataFrame:
    """Columns found in schema-less records, in the order in which they are first seen, over all rows."""
    return (
        df.select(F.col(order), F.posexplode(F.map_keys(_as_map(df, column))))
        .groupBy(F.col("col").alias("column_name"))
        .agg(F.min(F.struct(F.col(order).alias("rid"), F.col("pos"))).alias("seen"))
        .select("column_name", F.col("seen.rid").alias("first_row"), F.col("seen.pos").alias("first_pos"))
    )


def column_names(found: DataFrame) -> list[str]:
    """The names of `record_columns`, in order; their number is bounded by the schema, not by the rows."""
    return [r.column_name for r in found.orderBy("first_row", "first_pos").collect()]


def records_to_columns(df: DataFrame, columns: list[str], column: str = "row_data", keep: tuple = ()) -> DataFrame:
    """Schema-less records as a table with the given columns; absent values are null."""
    record = df.withColumn("_record", _as_map(df, column))
    return record.select(*keep, *[F.try_element_at("_record", F.lit(c)).alias(c) for c in columns])


def _as_map(df: DataFrame, column: str):
    if dict(df.dtypes)[column] == "string":
        return F.from_json(F.col(column), "map<string,string>")
    return F.col(column)


def latest_batch(staged: DataFrame) -> DataFrame:
    """Rows of the most recently staged batch. The batch id is a scalar subquery, so a staging table partitioned by
    batch_id is pruned to that batch."""
    newest = staged.agg(F.max_by("batch_id", F.struct("uploaded_at", "batch_id"))).scalar()
    return staged.where(F.col("batch_id") == newest)
