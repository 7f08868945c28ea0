"""Exact similarity join of key texts: TF-IDF cosine over character n-grams, found through rare n-grams.

Every vector is ordered by (document frequency, n-gram). Two vectors of cosine >= t share an n-gram inside the
leading parts whose remainder still has norm >= t, so only those leading parts are joined. A pair is kept when
w1*w2 + |rest1|*|rest2| can reach t, and then scored in full. Nothing is capped or sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tablematch.config import DEFAULTS, Settings
from tablematch.functions.text import char_grams
from tablematch.plans.skew import durable

_SLACK = 1e-9


def distinct_texts(rows: DataFrame) -> DataFrame:
    """Non-blank texts with the number of rows `n` and the first row as `id`. Repeated texts are compared once."""
    return (
        rows.where(F.trim("text") != "")
        .groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("id"))
    )


def vectors(left: DataFrame, right: DataFrame) -> DataFrame:
    """Unit vectors in long form: (side, id, n, df, gram, w, mass), `mass` being the squared norm of the n-gram and all
    that follow it by (df, gram). Weights are tf * (ln((1 + N) / (1 + df)) + 1) with N and df counted over the rows of
    both sides. A window holds the n-grams of one text."""
    texts = left.select(F.lit("l").alias("side"), "*").unionByName(right.select(F.lit("r").alias("side"), "*"))
    grams = (
        texts.select("side", "id", "n", F.explode(char_grams(F.col("text"))).alias("gram"))
        .groupBy("side", "id", "n", "gram").agg(F.count(F.lit(1)).alias("tf"))
    )
    rows = texts.agg(F.sum("n")).scalar()
    spread = grams.groupBy("gram").agg(F.sum("n").alias("df"))
    weight = F.col("tf") * (F.log((F.lit(1) + rows) / (F.lit(1) + F.col("df"))) + F.lit(1))
    ordered = Window.partitionBy("side", "id").orderBy("df", "gram")
    square = F.col("raw") * F.col("raw")
    total = F.sum(square).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = F.coalesce(F.sum(square).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weighted = grams.join(spread, "gram").withColumn("raw", weight).withColumn("total", total).withColumn("before", before)
    return weighted.select(
        "side", "id", "n", "df", "gram", (F.col("raw") / F.sqrt("total")).alias("w"), ((F.col("total") - F.col("before")) / F.col("total")).alias("mass")
    )


def _leading(vecs: DataFrame, side: str, threshold: float) -> DataFrame:
    """Leading n-grams of each vector with their weight and the norm of what follows."""
    rest = F.sqrt(F.greatest(F.col("mass") - F.col("w") * F.col("w"), F.lit(0.0)))
    return vecs.where((F.col("side") == side) & (F.col("mass") >= threshold * threshold - _SLACK)).select(
        F.col("id").alias(f"{side}_id"), "gram", F.col("w").alias(f"{side}_w"), rest.alias(f"{side}_rest")
    )


def candidates(vecs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (l_id, r_id) that can reach the threshold."""
    bound = F.col("l_w") * F.col("r_w") + F.col("l_rest") * F.col("r_rest")
    return (
        _leading(vecs, "l", threshold).join(_leading(vecs, "r", threshold), "gram")
        .where(bound >= F.lit(threshold - _SLACK))
        .select("l_id", "r_id").distinct()
    )


def similar_pairs(vecs: DataFrame, threshold: float) -> DataFrame:
    """All pairs (l_id, r_id, score) of cosine >= threshold, with the row counts of both texts.

    The two vectors of a pair, both in (df, gram) order, are merged into one sorted array, in which shared n-grams
    stand next to each other.
    """

    def side(name: str) -> DataFrame:
        vec = F.sort_array(F.collect_list(F.struct("df", "gram", "w"))).alias(f"{name}_vec")
        whole = vecs.where(F.col("side") == name).groupBy(F.col("id").alias(f"{name}_id"), F.col("n").alias(f"{name}_n"))
        return whole.agg(vec)

    def step(a, x):
        product = F.when(a["gram"] == x["gram"], a["w"] * x["w"]).otherwise(F.lit(0.0))
        return F.struct(x["gram"].alias("gram"), x["w"].alias("w"), (a["dot"] + product).alias("dot"))

    start = F.struct(F.lit("").alias("gram"), F.lit(0.0).alias("w"), F.lit(0.0).alias("dot"))
    merged = F.sort_array(F.concat("l_vec", "r_vec"))
    dot = F.aggregate(merged, start, step, lambda a: a["dot"])
    return (
        candidates(vecs, threshold).join(side("l"), "l_id").join(side("r"), "r_id")
        .select("l_id", "r_id", "l_n", "r_n", F.round(dot, 12).alias("score"))
        .where(F.col("score") >= threshold)
    )


def text_similarities(left: DataFrame, right: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Similar pairs of the distinct texts of two tables (rid, text). The vectors are used three times and are
    written once."""
    vecs = durable(vectors(distinct_texts(left), distinct_texts(right)))
    return similar_pairs(vecs, settings.similarity_threshold)
