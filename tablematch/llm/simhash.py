"""SimHash near-duplicates: close fingerprints share a block."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablematch.llm.common import components, keyed
from tablematch.plans.skew import durable, first_rows, release

_HASHES_AT_ONCE = 1 << 16
#: Fingerprints that one task compares at a time; larger buckets are split by further bits.
BUCKET = 20_000


def fingerprint(text: str | None, n_words: int) -> int:
    """64-bit SimHash of the shingles of `n_words` words, repeats included, hashed by XXH64 with seed 42."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    ends = ends[min(n_words, len(parts)) - 1:]
    n, counts = len(ends), np.zeros(64, np.int64)
    for i in range(0, n, _HASHES_AT_ONCE):
        spans = zip(starts[i:i + _HASHES_AT_ONCE].tolist(), ends[i:i + _HASHES_AT_ONCE].tolist())
        part = np.array([xxhash.xxh64_intdigest(line[s:e], 42) for s, e in spans], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", n_words: int = 5, out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint (long) of each text; null counts as empty. A-Z is lower-cased; shorter texts are one
    shingle, texts without words have fingerprint 0."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, n_words) for x in texts], dtype="int64")

    return docs.withColumn(out, of(F.col(text_col).cast("string")))


def _mask(bits) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def blocks(bits: int, n: int) -> list[list[int]]:
    return [list(range(64))[i * bits // n:(i + 1) * bits // n] for i in range(n)]


def first_masks(n_fingerprints: int, distance: int) -> list[int]:
    """Bit masks such that two fingerprints within `distance` agree on one of them at least: 64 bits in n blocks, of
    which distance blocks may differ, so n - distance agree. n is the smallest that gives masks of more bits than the
    number of fingerprints has; so unrelated fingerprints seldom meet, however many there are."""
    n = next((n for n in range(distance + 1, 64) if 64 * (n - distance) // n > n_fingerprints.bit_length()), 2 * distance + 2)
    return [_mask(b for i in kept for b in blocks(64, n)[i]) for kept in combinations(range(n), n - distance)]


def finer_masks(mask: int, distance: int) -> list[int]:
    """Masks with more bits that close fingerprints, which agree on `mask`, also agree on: the rest in distance + 1
    blocks. None when there is nothing left to split."""
    rest = [b for b in range(64) if not mask >> b & 1]
    if len(rest) <= distance:
        return []
    cut = [rest[i * len(rest) // (distance + 1):(i + 1) * len(rest) // (distance + 1)] for i in range(distance + 1)]
    taken = [b for b in range(64) if mask >> b & 1]
    return [_mask(taken + block) for block in cut]


def spanning(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what the links within `distance` connect, one less than there are fingerprints at most."""
    fps = np.unique(np.asarray(fps, np.int64))
    left, found = fps, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= distance
            found += [(int(x), int(y)) for y in left[near]]
            queue += list(left[near])
            left = left[~near]
    return found


def links(prints: DataFrame, distance: int = 4, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links among the distinct longs `fp` that give the same components as all pairs within `distance`.

    Fingerprints meet on blocks (`first_masks`). A bucket is compared in one task, which returns a spanning forest
    rather than all pairs; a bucket of more than `bucket` fingerprints is first split by further blocks
    (`finer_masks`), by the same argument and without losing a link, until it fits."""
    spark: SparkSession = prints.sparkSession
    masks = first_masks(prints.count(), distance)
    members = _masked(prints, F.array(*[F.lit(m).cast("long") for m in masks]))
    found = []
    while True:
        sizes = durable(members.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        fits = members.join(sizes.where(F.col("n") <= bucket).drop("n"), ["mask", "value"], "left_semi")

        @F.pandas_udf("array<struct<a:long,b:long>>")
        def forest(groups: pd.Series) -> pd.Series:
            return pd.Series([[{"a": a, "b": b} for a, b in spanning(g, distance)] for g in groups])

        grouped = fits.groupBy("mask", "value").agg(F.collect_list("fp").alias("fps"))
        found.append(durable(grouped.select(F.explode(forest("fps")).alias("e")).select("e.*").distinct()))
        large = sizes.where(F.col("n") > bucket)
        finer = {r.mask: finer_masks(r.mask, distance) for r in large.select("mask").distinct().collect()}
        if not any(finer.values()):
            break
        table = spark.createDataFrame([(m, f) for m, f in finer.items() if f], "mask long, finer array<long>")
        split = members.join(large.drop("n"), ["mask", "value"], "left_semi").join(F.broadcast(table), "mask")
        members = durable(_masked(split, F.col("finer")).distinct())
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _masked(prints: DataFrame, masks) -> DataFrame:
    return prints.select("fp", F.explode(masks).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))


def _labelled(rows: DataFrame, n_words: int, distance: int, bucket: int) -> DataFrame:
    """`rows` (_id, _h, _text) without the text, but with fingerprint `fp`, group `c` and its smallest id."""
    prints = durable(fingerprints(rows, "_text", n_words, "fp").select("_id", "_h", "fp"))
    distinct = durable(prints.groupBy("fp").agg(F.min("_id").alias("least")))
    joined = components(links(distinct.select("fp"), distance, bucket))
    named = durable(
        distinct.join(joined, distinct.fp == joined.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    )
    names = named.groupBy("c").agg(F.min("least").alias("component_id"))
    labels = durable(named.join(names, "c").select("fp", "c", "component_id"))
    release(distinct, named)
    return prints.join(labels, "fp")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, distance: int = 4, bucket: int = BUCKET,
) -> DataFrame:
    """(id, fingerprint long, component_id): documents that a chain of steps of `distance` differing bits or fewer
    connects share a component, named by its smallest id. Every row of `docs` gives a row, repeated ones too. Null or
    empty texts have fingerprint 0 and link like any other; null ids take part, but name a component only where it has
    no other id; an empty table gives an empty result. Other columns are not read."""
    out = _labelled(keyed(docs, id_col, text_col), n_words, distance, bucket)
    return out.select(F.col("_id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, distance: int = 4, bucket: int = BUCKET,
) -> DataFrame:
    """The rows of `docs`, one of each group: that of the smallest id (null last), of the smallest text hash among rows
    of one id, any one of equal rows. All columns stay as they are; nulls and empty tables as in `simhash_groups`."""
    groups = _labelled(keyed(docs, id_col, text_col), n_words, distance, bucket)
    rank = F.row_number().over(Window.partitionBy("c").orderBy(F.col("_id").asc_nulls_last(), "_h"))
    chosen = groups.withColumn("_rank", rank).where("_rank = 1").select(_name("_id").alias("_k"), "_h")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(_name(id_col).alias("_k"), F.xxhash64(text).alias("_h"), F.struct("*").alias("_row"))
    kept = rows.join(chosen, ["_k", "_h"], "left_semi")
    return first_rows(kept, ["_k", "_h"], "_h").select("_row.*")


def _name(id_col: str):
    """An id as a text that is never null, so that joins and windows can share one partitioning."""
    return F.coalesce(F.col(id_col).cast("string"), F.lit("\0"))
