"""Plans that stay balanced when one group holds a large share of the rows, and durable intermediate tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablematch.config import DEFAULTS, Settings

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_folder(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: `spark.checkpoint.dir` as the cluster names it, or a folder of the
    warehouse where that is unset (an error where a cluster's warehouse is a local folder). Each application has its own, which is removed when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/work"
        if not spark.sparkContext.master.startswith("local") and re.match("^(file:|/)", base):
            raise ValueError("on a cluster, spark.checkpoint.dir names the shared folder for intermediate tables; the warehouse is a local one")
    folder = f"{base.rstrip('/')}/tablematch-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Write `df` to the work folder and read it back: the lineage ends here and survives lost executors, and the
    table's real size is known to the planner from then on. The shuffle files of the write go when it ends."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Remove the files of `durable` tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        folder = work_folder(spark)
        for file in table.inputFiles():
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if path.toString().rpartition("/")[0].endswith(folder.rpartition("/")[2]):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
                break


def hot_groups(df: DataFrame, keys: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """Hashes (`_hot`) of the groups too large for one task: those above `hot_group_rows` rows, so that there are at most as
    many as the table has that many rows."""
    sizes = df.groupBy(F.xxhash64(*keys).alias("_hot")).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.where(F.col("_n") > settings.hot_group_rows).select("_hot")


def find_hot(df: DataFrame, keys: list[str], settings: Settings = DEFAULTS) -> DataFrame | None:
    """The hot groups of `df`, or None when there are none: one aggregate over the keys alone. Without hot groups the
    plans below stay plain windows."""
    hot = hot_groups(df.select(*keys), keys, settings)
    return None if hot.isEmpty() else hot


def ranked(
    df: DataFrame, keys: list[str], order: str, out: str, hot: DataFrame | None, hot_by: list[str] | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Add the 1-based position `out` of each row inside its group by `order` (a unique, non-negative long).

    Same result as row_number() over the group. A hot group (see `find_hot`, taken over `hot_by`, a subset of the
    keys) is cut into slices of consecutive `order` values, ranked slice by slice in separate tasks, and shifted by
    the number of rows in earlier slices. How the list of hot groups is joined is left to its real size.
    """
    if hot is None:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long"))
    sliced = (
        df.withColumn("_group", F.xxhash64(*(hot_by or keys)))
        .join(hot, F.col("_group") == F.col("_hot"), "left")
        .withColumn("_slice", F.when(F.col("_hot").isNotNull(), F.floor(F.col(order) / settings.hot_group_rows)).otherwise(F.lit(-1)))
    )
    heads = (
        sliced.where(F.col("_slice") >= 0)
        .groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_before",
            F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)),
        )
        .select(*keys, "_slice", "_before")
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(order)).cast("long")
    return (
        sliced.withColumn("_inside", inside)
        .join(heads, [*keys, "_slice"], "left")
        .withColumn(out, F.col("_inside") + F.coalesce(F.col("_before"), F.lit(0)))
        .select(*df.columns, out)
    )


def first_rows(df: DataFrame, keys: list[str], order: str = "_rid") -> DataFrame:
    """First row of each group. The planner puts a partial limit before the shuffle (WindowGroupLimit), so a hot
    group sends one row per input partition."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def group_heads(df: DataFrame, keys: list[str], order: str = "_rid") -> DataFrame:
    """One row per group: its first row as struct `row` and its size `n`; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("row"), F.count(F.lit(1)).alias("n"))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First `n` rows per group; limited before the shuffle as in `first_rows`."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
