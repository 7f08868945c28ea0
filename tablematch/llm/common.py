"""What several corpus operators share: words, document keys, components of a graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tablematch.plans.skew import durable, release

#: Words are the runs between these characters.
SPACES = r"[\x20\x09-\x0D]+"


def words(text: str | Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACES), "")


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(_id, _h, _text, *more): `_h` tells rows of one id apart by their text, so that (_id, _h) stands for one id and text.
    Rows equal in both get equal results. A null text is empty; a null id is an id of its own."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h"), text.alias("_text"), *more)


def same_key(a: DataFrame, b: DataFrame) -> Column:
    return a["_id"].eqNullSafe(b["_id"]) & (a["_h"] == b["_h"])


def batch_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of a batch of texts: their codes one after the other, where each text begins and ends among them, and
    the distinct words by code."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, bounds = lists.flatten(), np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        bounds, flat = np.r_[0, np.cumsum(full)][bounds], flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return (
        coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds.astype(np.int64),
        coded.dictionary.cast(pa.binary()).to_pylist(),
    )


def hashes(distinct: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in distinct), np.uint64, len(distinct))


def slices(batches, text: str, most: int = 4 << 20):
    """Cut record batches so that each has about `most` bytes of text, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def mixed(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash, so that all bits depend on all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that links reach from each node of `edges` (two columns of longs).

    Large stars and small stars in turn: each node hangs its larger neighbours, then its smaller ones, on its smallest
    neighbour, until nothing changes; that takes a number of rounds logarithmic in the longest path. Only minima are
    aggregated, so a node with very many links costs one row per task, and they are tables of one row per node, so that the
    joins can split such a node's links; every round is written to the work folder. No edges: no rows."""
    links = durable(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct())
    state = _state(links)
    while state[0]:
        both = links.union(links.select(F.col("b"), F.col("a")))
        least = durable(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        stars = durable(both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct())
        down = stars.select(F.col("b").alias("a"), F.col("a").alias("b"))
        lower = durable(down.groupBy("a").agg(F.min("b").alias("m")))
        hung = down.join(lower, "a").select(F.explode(F.array("a", "b")).alias("b"), F.col("m").alias("a"))
        after = durable(hung.select("a", "b").where("a < b").distinct())
        release(links, least, stars, lower)
        links, last, state = after, state, _state(after)
        if state == last:
            break
    roots = links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
