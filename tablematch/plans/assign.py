"""One-to-one assignments: best-first over a scored pair table, optimal over small column matrices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tablematch.config import DEFAULTS, Settings
from tablematch.plans.similarity import text_similarities
from tablematch.plans.skew import durable, find_hot, ranked

_BLOCK = 1024


def tie_break(left: str, right: str) -> Column:
    """Hash of a pair, the first 60 bits of the MD5 of `left:right`; the larger goes first."""
    pair = F.concat_ws(":", F.col(left).cast("string"), F.col(right).cast("string"))
    return F.conv(F.substring(F.md5(pair), 1, 15), 16, 10).cast("long")


def best_first(edges: DataFrame) -> DataFrame:
    """Best-first assignment over edges (l_id, r_id, l_n, r_n, score), the nodes having capacities l_n and r_n.

    Edges are ordered by score, then by a hash of the pair (see `tie_break`), so that equal scores do not queue up behind
    one node. Under a strict order best-first equals taking, again and again, every edge that is the best of both its
    ends; with ties in random order that takes few rounds, whatever the number of equal scores. Best edges are found by aggregates, which combine before the shuffle, so a node with
    very many edges is no problem. Each round ends in a written table. Returns segments
    (l_id, r_id, score, l_from, r_from, m): m members of both nodes, counted from the given positions.
    """
    left = durable(edges.select("l_id", "r_id", "score", tie_break("l_id", "r_id").alias("tie"), "l_n", "r_n", F.lit(0).cast("long").alias("l_from"), F.lit(0).cast("long").alias("r_from")))
    taken = []
    while not left.isEmpty():
        by_left = left.groupBy("l_id").agg(F.max(F.struct("score", "tie", "r_id")).alias("b")).select("l_id", "b.r_id")
        by_right = left.groupBy("r_id").agg(F.max(F.struct("score", "tie", "l_id")).alias("b")).select("b.l_id", "r_id")
        mutual = by_left.join(by_right, ["l_id", "r_id"])
        chosen = durable(
            left.join(mutual, ["l_id", "r_id"]).withColumn("m", F.least("l_n", "r_n"))
            .select("l_id", "r_id", "score", "l_from", "r_from", "m")
        )
        taken.append(chosen)
        used_l = chosen.select("l_id", F.col("m").alias("l_m"))
        used_r = chosen.select("r_id", F.col("m").alias("r_m"))
        l_m, r_m = F.coalesce("l_m", F.lit(0)), F.coalesce("r_m", F.lit(0))
        left = durable(
            left.join(used_l, "l_id", "left").join(used_r, "r_id", "left")
            .select(
                "l_id", "r_id", "score", "tie", (F.col("l_n") - l_m).alias("l_n"), (F.col("r_n") - r_m).alias("r_n"),
                (F.col("l_from") + l_m).alias("l_from"), (F.col("r_from") + r_m).alias("r_from"),
            )
            .where("l_n > 0 and r_n > 0")
        )
    if not taken:
        return left.withColumn("m", F.col("l_n")).select("l_id", "r_id", "score", "l_from", "r_from", "m")
    out = taken[0]
    for part in taken[1:]:
        out = out.unionByName(part)
    return out


def _members(rows: DataFrame, segments: DataFrame, side: str, settings: Settings) -> DataFrame:
    """Rows of the segments with their place `k` in the segment. Segments are cut into blocks of positions, so the
    join is an equi join and a row meets at most one block's worth of segments."""
    start, end = F.col(f"{side}_from"), F.col(f"{side}_from") + F.col("m")
    blocks = segments.withColumn(
        "block", F.explode(F.sequence(F.floor(start / _BLOCK), F.floor((end - 1) / _BLOCK)))
    )
    ids = rows.groupBy("text").agg(F.min("rid").alias(f"{side}_id"))
    placed = (
        ranked(rows, ["text"], "rid", "pos", find_hot(rows, ["text"], settings), settings=settings).join(ids, "text")
        .withColumn("pos", F.col("pos") - 1).withColumn("block", F.floor(F.col("pos") / _BLOCK))
    )
    return (
        placed.join(blocks, [f"{side}_id", "block"])
        .where((F.col("pos") >= start) & (F.col("pos") < end))
        .select("l_id", "r_id", "score", (F.col("pos") - start).alias("k"), F.col("rid").alias(f"{side}_rid"))
    )


def match_texts(left: DataFrame, right: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Best-first 1:1 pairs (left_rid, right_rid, score) of the rows of two tables (rid, text). Rows of one text
    share its score and are taken in row order, k-th with k-th."""
    edges = durable(text_similarities(left, right, settings))
    segments = best_first(edges)
    if edges.where("l_n > 1 or r_n > 1").isEmpty():
        # every text stands for one row, whose ordinal is the text's id
        return segments.select(F.col("l_id").alias("left_rid"), F.col("r_id").alias("right_rid"), "score")
    l_rows = _members(left.where(F.trim("text") != ""), segments, "l", settings)
    r_rows = _members(right.where(F.trim("text") != ""), segments, "r", settings).drop("score")
    return l_rows.join(r_rows, ["l_id", "r_id", "k"]).select(
        F.col("l_rid").alias("left_rid"), F.col("r_rid").alias("right_rid"), "score"
    )


def optimal_pairs(score: np.ndarray) -> list[tuple[int, int]]:
    """Row/column pairs of maximal total score, one-to-one, by shortest augmenting paths with node prices."""
    flipped = score.shape[0] > score.shape[1]
    cost = 1.0 - (score.T if flipped else score)
    rows, cols = cost.shape
    row_price, col_price = np.zeros(rows), np.zeros(cols)
    owner = np.full(cols, -1)
    for new_row in range(rows):
        distance = np.full(cols, np.inf)
        came_from = np.full(cols, -1)
        settled = np.zeros(cols, dtype=bool)
        row, last, reach = new_row, -1, 0.0
        while True:
            step = reach + cost[row] - row_price[row] - col_price
            closer = ~settled & (step < distance - 1e-15)
            distance[closer] = step[closer]
            came_from[closer] = last
            last = int(np.argmin(np.where(settled, np.inf, distance)))
            reach = distance[last]
            settled[last] = True
            if owner[last] < 0:
                break
            row = owner[last]
        row_price[new_row] += reach
        for col in np.flatnonzero(settled):
            if owner[col] >= 0:
                row_price[owner[col]] += reach - distance[col]
            col_price[col] -= reach - distance[col]
        while last >= 0:
            back = came_from[last]
            owner[last] = new_row if back < 0 else owner[back]
            last = back
    pairs = [(int(owner[c]), c) for c in range(cols) if owner[c] >= 0]
    return sorted((c, r) if flipped else (r, c) for r, c in pairs)


def assign_columns(scores: DataFrame) -> DataFrame:
    """Optimal 1:1 column assignment of many table pairs at once. Input (pair_id, source_pos, target_pos, score); a pair
    of columns that is not given scores nothing. Spark deals out the table pairs;
    a group is the column matrix of one table pair, so its size is bounded by the two schemas."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        matrix = pdf.pivot(index="source_pos", columns="target_pos", values="score").sort_index().sort_index(axis=1).fillna(0.0)
        chosen = optimal_pairs(matrix.to_numpy())
        return pd.DataFrame(
            {
                "pair_id": pdf["pair_id"].iloc[0],
                "source_pos": [int(matrix.index[r]) for r, _ in chosen],
                "target_pos": [int(matrix.columns[c]) for _, c in chosen],
            }
        )

    return scores.groupBy("pair_id").applyInPandas(solve, "pair_id string, source_pos int, target_pos int")
