"""What a comparison says: counts, column changes, trends, shapes, clusters, sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablematch.config import DEFAULTS, Settings
from tablematch.functions.values import percent, strict_number
from tablematch.operators.cells import has_kind
from tablematch.operators.days import busiest_day
from tablematch.operators.master import Comparison, duplicate_keys
from tablematch.plans.skew import durable, top_per_group

BUCKETS = (
    "missing_in_target", "missing_in_source", "duplicates_source", "duplicates_target", "mismatches",
    "format_inconsistencies", "fuzzy_matches", "full_comparison",
)


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def bucket_counts(comparison: Comparison) -> DataFrame:
    """One row with the size of every bucket and of both tables. A row with value and format changes is in both
    buckets; `matched` counts rows without any change."""
    paired = F.col("confidence").isNull()
    status = F.col("status")
    rows = comparison.rows.agg(
        F.count_if(status == "Deleted").alias("missing_in_target"),
        F.count_if(status == "Added").alias("missing_in_source"),
        F.count_if(paired & has_kind("value")).alias("mismatches"),
        F.count_if(paired & has_kind("format")).alias("format_inconsistencies"),
        F.count_if(status == "Renamed").alias("fuzzy_matches"),
        F.count_if(status == "Matched").alias("matched"),
        F.count("*").alias("full_comparison"),
    )

    def size(df: DataFrame) -> Column:
        return df.agg(F.count("*")).scalar()

    def repeated(df: DataFrame) -> Column:
        """Rows in duplicate groups, from the group sizes alone."""
        if comparison.duplicates_source is None:
            return F.lit(0).cast("long")
        return duplicate_keys(df, comparison.layout.keys).agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()

    return (
        rows.withColumn("duplicates_source", repeated(comparison.source))
        .withColumn("duplicates_target", repeated(comparison.target))
        .withColumn("source_record_count", size(comparison.source))
        .withColumn("target_record_count", size(comparison.target))
    )


def churn(counts: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Share of touched rows in percent with its label."""
    touched = (
        F.col("missing_in_source") + F.col("missing_in_target") + F.col("mismatches") + F.col("duplicates_source")
        + F.col("duplicates_target")
    )
    out = counts.withColumn("touched", touched).withColumn(
        "churn_percent", percent(F.col("touched"), F.greatest("source_record_count", "target_record_count"))
    )
    label = F.lit(settings.churn_last)
    for limit, text in reversed(settings.churn_steps):
        label = F.when(F.col("churn_percent") < limit, text).otherwise(label)
    return out.withColumn("churn_label", label)


def cell_changes(rows: DataFrame, renamed: bool = False) -> DataFrame:
    """One line per changed cell: column_name, source_value, target_value, kind. Renamed records are told by their
    confidence, which costs nothing, rather than by the status, which is derived from the differences."""
    picked = rows if renamed else rows.where("confidence is null")
    return picked.select(F.inline("diffs")).withColumnRenamed("column", "column_name")


def column_changes(rows: DataFrame, renamed: bool = False) -> DataFrame:
    """Changed cells per column, value and format changes together."""
    return cell_changes(rows, renamed).groupBy("column_name").agg(F.count("*").alias("n"))


def top_columns(rows: DataFrame, n: int = 5, renamed: bool = False) -> DataFrame:
    return column_changes(rows, renamed).orderBy(F.desc("n"), "column_name").limit(n)


def _deltas(cells: DataFrame) -> DataFrame:
    return cells.withColumn("delta", strict_number(F.col("target_value")) - strict_number(F.col("source_value")))


def numeric_trends(rows: DataFrame) -> DataFrame:
    """Per column with numeric value changes: how many, in which direction, and the mean change."""
    found = _deltas(cell_changes(rows).where("kind = 'value'")).where("delta is not null")
    counted = found.groupBy("column_name").agg(
        F.count("*").alias("n"), F.count_if(F.col("delta") > 0).alias("up"), F.count_if(F.col("delta") < 0).alias("down"),
        F.round(F.sum("delta").cast("decimal(38,6)") / F.count("*"), 2).cast("double").alias("avg_change"),
    )
    flat = F.col("n") - F.col("up") - F.col("down")
    direction = (
        F.when((F.col("up") > 0) & (F.col("down") == 0) & (flat == 0), "increased")
        .when((F.col("down") > 0) & (F.col("up") == 0) & (flat == 0), "decreased")
        .when((F.col("up") >= F.col("down") * 2) & (F.col("up") > flat), "mostly increased")
        .when((F.col("down") >= F.col("up") * 2) & (F.col("down") > flat), "mostly decreased")
        .otherwise("moved in both directions")
    )
    return counted.select("column_name", "n", direction.alias("direction"), "avg_change")


def change_shapes(cells: DataFrame, by: list[str]) -> DataFrame:
    """Size and overall shape of each group of changed cells."""
    before, after = F.trim("source_value") != "", F.trim("target_value") != ""
    counted = _deltas(cells).groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(before & ~after).alias("cleared"), F.count_if(~before & after).alias("filled"),
        F.count("delta").alias("numeric"), F.count_if(F.col("delta") > 0).alias("up"), F.count_if(F.col("delta") < 0).alias("down"),
    )
    enough = F.col("numeric") >= F.col("n") * 0.6
    up, down = F.col("up"), F.col("down")
    shape = (
        F.when(F.col("cleared") >= F.col("n") * 0.6, "cleared out")
        .when(F.col("filled") >= F.col("n") * 0.6, "filled in for the first time")
        .when(enough & (up > 0) & (down == 0), "increased")
        .when(enough & (down > 0) & (up == 0), "decreased")
        .when(enough & (up >= down * 2), "mostly increased")
        .when(enough & (down >= up * 2), "mostly decreased")
        .otherwise("changed to a different value")
    )
    return counted.select(*by, "n", shape.alias("shape"))


def clusters(rows: DataFrame, most: int = 4, seed: int = 42) -> DataFrame:
    """Groups of similar changes: word 1-2-gram TF-IDF of `column kind before after`, k-means, then per cluster its
    leading column, size and shape. Terms are hashed, so no vocabulary is built on the driver."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover

    spark = rows.sparkSession
    empty = "cluster int, column_name string, n long, shape string"
    kind = F.when(F.col("kind") == "value", "value change").otherwise("formatting difference")
    cells = cell_changes(rows).withColumn("text", F.concat_ws(" ", "column_name", kind, "source_value", "target_value"))
    n = cells.count()
    if n < 4:
        return spark.createDataFrame([], empty)
    k = max(2, min(most, n // 3))
    features = Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="tokens", pattern=r"\b\w\w+\b", gaps=False),
        StopWordsRemover(inputCol="tokens", outputCol="words"),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__"),
        HashingTF(inputCol="terms", outputCol="tf"),
        IDF(inputCol="tf", outputCol="idf"),
        Normalizer(inputCol="idf", outputCol="features"),
    ])
    # k-means reads the features many times
    vectors = durable(features.fit(cells).transform(cells).select("column_name", "source_value", "target_value", "features"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(vectors)
    labelled = model.transform(vectors).select("cluster", "column_name", "source_value", "target_value")
    per_column = labelled.groupBy("cluster", "column_name").agg(F.count("*").alias("n"))
    leading = per_column.groupBy("cluster").agg(F.max_by("column_name", "n").alias("column_name"))
    return change_shapes(labelled, ["cluster"]).join(leading, "cluster").select("cluster", "column_name", "n", "shape")


def sample_keys(comparison: Comparison, n: int = 8) -> DataFrame:
    """First keys of the deleted, added and duplicate buckets, as text, in row order."""
    keys = comparison.layout.keys
    text = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.col(k)) for k in keys])

    def of(df: DataFrame, bucket: str, rid: Column) -> DataFrame:
        return df.select(F.lit(bucket).alias("bucket"), text.alias("key"), rid.alias("_rid"))

    rows = comparison.rows
    parts = [
        of(rows.where("status = 'Deleted'"), "missing_in_target", F.col("src._rid")),
        of(rows.where("status = 'Added'"), "missing_in_source", F.col("tgt._rid")),
    ]
    if comparison.duplicates_source is not None:
        parts.append(of(comparison.duplicates_source, "duplicates_source", F.col("_rid")))
        parts.append(of(comparison.duplicates_target, "duplicates_target", F.col("_rid")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return top_per_group(every, ["bucket"], [F.col("_rid")], n).select("bucket", "key")


def digest(comparison: Comparison, columns: int = 5, keys: int = 8) -> DataFrame:
    """Short account of a comparison as (section, name, value) rows: counts, most changed columns, sample keys."""
    counts = bucket_counts(comparison)
    stats = counts.select(*[F.col(c).cast("string").alias(c) for c in counts.columns]).unpivot([], counts.columns, "name", "value")
    top = top_columns(comparison.rows, columns, renamed=True).select(F.col("column_name").alias("name"), F.col("n").cast("string").alias("value"))
    samples = sample_keys(comparison, keys).select(F.col("bucket").alias("name"), F.col("key").alias("value"))
    return (
        stats.select(F.lit("count").alias("section"), "name", "value")
        .unionByName(top.select(F.lit("column").alias("section"), "name", "value"))
        .unionByName(samples.select(F.lit("sample").alias("section"), "name", "value"))
    )


def _plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, one).otherwise(many)


def narrative(
    comparison: Comparison, days: DataFrame, before: str = "Source", after: str = "Target", cluster: DataFrame | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Sentences (pos, sentence) that describe a comparison. Everything they need is first reduced to one row whose
    size depends on the number of columns only."""
    spark = comparison.rows.sparkSession
    keys = ", ".join(comparison.layout.keys) or "a matching column"
    if cluster is None:
        cluster = spark.createDataFrame([], "cluster int, column_name string, n long, shape string")
    by_n = lambda a, b: F.when(a["n"] > b["n"], -1).when(a["n"] < b["n"], 1).when(a["column_name"] < b["column_name"], -1).otherwise(1)

    def listed(df: DataFrame, name: str, *fields: str) -> DataFrame:
        return df.agg(F.array_sort(F.collect_list(F.struct("column_name", "n", *fields)), by_n).alias(name))

    facts = churn(bucket_counts(comparison), settings)
    busiest = busiest_day(days).select(F.struct("*").alias("b"))
    facts = (
        facts.withColumn("busiest", busiest.scalar())
        .withColumn("busiest_day", F.col("busiest.busiest_day")).withColumn("has_undated", F.col("busiest.has_undated"))
        .withColumn("columns", listed(column_changes(comparison.rows), "columns").scalar())
        .withColumn("trends", listed(numeric_trends(comparison.rows), "trends", "direction", "avg_change").scalar())
        .withColumn("groups", listed(cluster, "groups", "shape").scalar())
    )
    n = {k: F.col(v) for k, v in {
        "added": "missing_in_source", "deleted": "missing_in_target", "updated": "mismatches", "renamed": "fuzzy_matches",
        "formats": "format_inconsistencies", "dup_s": "duplicates_source", "dup_t": "duplicates_target",
    }.items()}
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])

    headline = text(
        f"{before}: ", F.col("source_record_count"), f" rows, {after}: ", F.col("target_record_count"), f" rows, paired by {keys}. ",
        F.col("churn_percent"), "% of the rows differ (", F.col("churn_label"), ").",
    )
    bits = F.array_compact(F.array(
        F.when(n["added"] > 0, text(n["added"], f" only in {after}")),
        F.when(n["deleted"] > 0, text(n["deleted"], f" only in {before}")),
        F.when(n["updated"] > 0, text(n["updated"], " with other values")),
    ))
    changes = F.when(F.size(bits) > 0, F.concat(F.lit("Records: "), F.array_join(bits, ", "), F.lit("."))).otherwise(
        F.lit(f"Records: the same in {before} and {after}.")
    )
    renames = F.when(n["renamed"] > 0, text(
        "Renamed: ", n["renamed"], " record", _plural(n["renamed"], "", "s"), ", paired by similar key texts.",
    ))
    twice = F.array_compact(F.array(
        F.when(n["dup_s"] > 0, text(n["dup_s"], f" in {before}")), F.when(n["dup_t"] > 0, text(n["dup_t"], f" in {after}"))
    ))
    dups = F.when(F.size(twice) > 0, text(
        f"Rows that share their {keys} with another row: ", F.array_join(twice, ", "), ".",
    ))
    lead = F.try_element_at("columns", F.lit(1))
    everything = F.aggregate("columns", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    shape = F.try_element_at(F.filter("groups", lambda g: g["column_name"] == lead["column_name"]), F.lit(1))["shape"]
    one_place = text(
        "Changed cells lie mainly in '", lead["column_name"], "' (", lead["n"], ")", F.coalesce(text(", mostly ", shape), F.lit("")), ".",
    )
    names = F.array_join(F.transform(F.slice("columns", 1, 3), lambda c: F.concat(F.lit("'"), c["column_name"], F.lit("'"))), ", ")
    spread = text("Changed cells lie in several columns, first of all in ", names, ".")
    columns = F.when(F.size("columns") > 0, F.when(percent(lead["n"], everything) >= 40, one_place).otherwise(spread))
    others = F.filter("groups", lambda g, i: (g["column_name"] != F.coalesce(lead["column_name"], F.lit(""))) & (g["n"] >= 3))
    firsts = F.filter(others, lambda g, i: F.array_position(F.transform(others, lambda x: x["column_name"]), g["column_name"]) == i + 1)
    more = F.transform(F.slice(firsts, 1, 2), lambda g: F.concat(
        F.lit("Further changes in '"), g["column_name"], F.lit("': "), g["n"].cast("string"), F.lit(", mostly "), g["shape"], F.lit(".")
    ))
    clear = F.filter(F.slice("trends", 1, 3), lambda t: t["direction"] != "moved in both directions")
    trends = F.transform(clear, lambda t: F.concat(
        F.lit("Mean change of '"), t["column_name"], F.lit("': "), F.abs(t["avg_change"]).cast("string"), F.lit(" ("), t["direction"], F.lit(f" in {after})."),
    ))
    formats = F.when(n["formats"] > 0, text(
        "Written otherwise but equal in value: ", n["formats"], " record", _plural(n["formats"], "", "s"), ".",
    ))
    busy = F.when(F.col("busiest_day").isNotNull(), text(
        "Day with most changes: ", F.col("busiest_day"), "."
    ))
    undated = F.when(F.col("has_undated"), F.lit("Rows without a readable date count as 'Undated'."))
    full = F.array_compact(F.concat(
        F.array(headline, changes, renames, dups, columns), more, trends, F.array(formats, busy, undated)
    ))
    same = F.array(F.lit(f"{before} and {after} agree on every record (paired by {keys})."))
    sentences = F.when((F.col("touched") == 0) & (n["renamed"] == 0), same).otherwise(full)
    return facts.select(F.posexplode(sentences).alias("pos", "sentence"))
