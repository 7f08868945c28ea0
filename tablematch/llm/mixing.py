"""Mixing sources to target weights: each document is repeated as often as a Poisson variable of its own says."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from tablematch.plans.skew import durable

SEED = 17


def repetition_rates(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, text_col: str = "text", source_col: str = "source",
    size: float = 1.0,
) -> DataFrame:
    """(source, share, rate): how often documents of a source come on average, so that the sources have characters in
    proportion to `weights` and the mixture `size` times those of `docs`. No weights: all sources the same; sources
    without a weight get none; a source without characters has rate 0."""
    sums = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.sum(F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0))).alias("chars"))
    weight = F.lit(1.0) if weights is None else F.lit(0.0)
    for name, value in (weights or {}).items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    sums = durable(sums.withColumn("weight", F.when(F.col("chars") > 0, weight).otherwise(F.lit(0.0))))
    total = sums.agg(F.sum("chars").cast("double").alias("all_chars"), F.sum("weight").alias("all_weight"))
    share = F.coalesce(F.try_divide("weight", "all_weight"), F.lit(0.0))
    rate = F.coalesce(F.try_divide(F.lit(float(size)) * share * F.col("all_chars"), F.col("chars").cast("double")), F.lit(0.0))
    return sums.crossJoin(F.broadcast(total)).select("source", share.alias("share"), rate.alias("rate"))  # one row of totals


def mix(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", size: float = 1.0, seed: int = SEED,
) -> DataFrame:
    """The rows of `docs`, each as often as drawn, with their number `copy` from 1, in random order.

    The draw inverts the Poisson distribution of the source's rate at a number in [0, 1) that is a hash of seed and id, so
    that it is the same in every run and on every executor; rows of one id and source come equally often. All columns stay;
    a column `copy` is replaced. Null sources are one source, null ids one id; an empty table gives an empty result. The
    rows are dealt to partitions and sorted there by another hash of seed, id and copy."""
    rates = repetition_rates(docs, weights, text_col, source_col, size)
    # log of the probabilities, so that none underflows before it matters
    terms = "sequence(1, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS INT))"
    step = "named_struct('lp', a.lp + ln(rate / j), 'sum', a.sum + exp(a.lp + ln(rate / j)), 'cdf', array_append(a.cdf, a.sum + exp(a.lp + ln(rate / j))))"
    cdf = F.expr(f"aggregate({terms}, named_struct('lp', -rate, 'sum', exp(-rate), 'cdf', array(exp(-rate))), (a, j) -> {step}, a -> a.cdf)")
    drawn = durable(rates.where("rate > 0").select(F.col("source").alias("_source"), cdf.alias("_cdf")))
    kept = [c for c in docs.columns if c != "copy"]
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)
    rows = docs.select(F.struct(*kept).alias("_row"), F.col(source_col).cast("string").alias("_s"), name.alias("_name"), u.alias("_u"))
    copies = (
        rows.join(drawn, F.col("_s").eqNullSafe(F.col("_source")))
        .withColumn("_n", F.size(F.filter("_cdf", lambda x: x <= F.col("_u")))).where("_n > 0")
        .select("_row", "_name", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))
    )
    order = F.xxhash64(F.lit(seed), "_name", "copy")
    return copies.withColumn("_order", order).repartition("_order").sortWithinPartitions("_order").select("_row.*", "copy")


SQL = f"""
WITH sums AS (SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS chars FROM documents GROUP BY source),
rates AS (
    SELECT source, CASE WHEN chars > 0 THEN (1.0::DOUBLE / (SELECT count(*) FROM sums WHERE chars > 0)) * (SELECT sum(chars) FROM sums) / chars ELSE 0 END AS rate
    FROM sums
), terms AS (
    SELECT source, rate, j, -rate + coalesce(sum(CASE WHEN j > 0 THEN ln(rate / j) END) OVER (PARTITION BY source ORDER BY j), 0) AS lp
    FROM rates, range(0, 1000) r(j) WHERE rate > 0 AND j <= ceil(rate + 12 * sqrt(rate) + 30)
), cdf AS (
    SELECT source, list(c ORDER BY j) AS cdf FROM (SELECT source, j, sum(exp(lp)) OVER (PARTITION BY source ORDER BY j) AS c FROM terms)
    GROUP BY source
), drawn AS (
    SELECT d.*, len(list_filter(cdf, lambda x: x <= ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)) AS n
    FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source
)
SELECT * EXCLUDE (n, copy), copy::INTEGER AS copy FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM drawn WHERE n > 0)
"""
