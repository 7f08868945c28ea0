"""Near-duplicate vectors by spherical caps: vectors that lie in the same caps are compared.

The cap centres are a product code: the dimensions are cut into blocks, each block has random directions of its own, and
every choice of one direction per block is a centre. Few directions so give very many centres, and the caps a vector lies
in are found without visiting all: block sums that cannot reach the cap's edge any more are given up early.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablematch.llm.common import components
from tablematch.plans.skew import durable, release

#: Caps a vector lies in on average, vectors per cap on average, and vectors that one task compares.
CAPS, MEMBERS, TILE, SEED = 24, 64, 2048, 5
_CENTRES_BY_TWO = 1 << 24


@lru_cache(maxsize=8)
def directions(dim: int, blocks: int, size: int, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng([seed, dim, blocks, size])
    out = []
    for part in np.array_split(np.arange(dim), blocks):
        d = rng.standard_normal((size, len(part)))
        out.append(d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-300) / math.sqrt(blocks))
    return out


def within(scores: list[np.ndarray], edge: float) -> np.ndarray:
    """Numbers of the centres whose block scores add up to `edge` or more."""
    most, size = [s.max() for s in scores], len(scores[0])
    sums, numbers = np.zeros(1), np.zeros(1, np.int64)
    for k, s in enumerate(scores):
        open_ = s >= edge - sums.max() - sum(most[k + 1:])
        some = np.flatnonzero(open_)
        sums = (sums[:, None] + s[None, some]).ravel()
        numbers = (numbers[:, None] * size + some[None, :]).ravel()
        open_ = sums + sum(most[k + 1:]) >= edge
        sums, numbers = sums[open_], numbers[open_]
        if not len(sums):
            break
    return np.sort(numbers)


def block_scores(vector: np.ndarray, code: list[np.ndarray]) -> list[np.ndarray]:
    ends = np.cumsum([block.shape[1] for block in code])
    return [block @ vector[end - block.shape[1]:end] for block, end in zip(code, ends)]


@lru_cache(maxsize=8)
def cap_edge(dim: int, blocks: int, size: int, seed: int, caps: int) -> float:
    """The edge at which a random direction lies in `caps` caps on average, found on a few random directions."""
    rng = np.random.default_rng([seed, dim, 1])
    code = directions(dim, blocks, size, seed)
    scores = [block_scores(v / np.linalg.norm(v), code) for v in rng.standard_normal((48, dim))]
    low, high = 0.0, 1.0
    for _ in range(20):
        edge = (low + high) / 2
        # a few blocks decide whether the edge is far too low; do not list those caps
        few = all(np.count_nonzero(s[0] >= edge - sum(x.max() for x in s[1:])) < size // 2 for s in scores)
        n = np.mean([len(within(s, edge)) for s in scores]) if few or size <= 512 else 2 * caps
        low, high = (edge, high) if n > caps else (low, edge)
    return high


def caps_of(vector: np.ndarray, code: list[np.ndarray], edge: float, least: int) -> np.ndarray:
    """Numbers of the caps that hold the unit vector. Where it lies in fewer than `least`, the edge of its caps is lowered
    until there are so many, so that no vector is left without."""
    scores = block_scores(vector, code)
    reachable = sum(s.max() for s in scores)
    least = min(least, len(code[0]) ** len(code))
    numbers, edge = within(scores, edge), min(edge, reachable)
    while len(numbers) < least:
        edge -= 0.05 * abs(edge) + 1e-3
        numbers = within(scores, edge)
    return numbers


def local_roots(linked: np.ndarray) -> np.ndarray:
    """For each node of a symmetric link matrix the smallest node that links reach."""
    root = np.arange(len(linked))
    while True:
        near = np.where(linked, root[None, :], len(root)).min(axis=1, initial=len(root))
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def compared(ids: np.ndarray, units: np.ndarray, caps: list[np.ndarray], side: np.ndarray | None, cap: int, threshold: float):
    """For the vectors of one cap: how many links each has whose first common cap is this one, and the smallest id that
    its links here reach. `side`: of a cap in tiles, which of the two parts (compared with each other only)."""
    cosine = units @ units.T
    linked = cosine >= threshold
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    lower = [c[c < cap] for c in caps]
    numbers, counts = np.unique(np.concatenate(lower), return_counts=True)
    numbers = numbers[counts > 1]
    member = np.zeros((len(ids), len(numbers)), np.float32)
    for i, c in enumerate(lower):
        at = np.searchsorted(numbers, c)
        held = at < len(numbers)
        held[held] = numbers[at[held]] == c[held]
        member[i, at[held]] = 1
    earlier = member @ member.T > 0 if len(numbers) else np.zeros_like(linked)
    return (linked & ~earlier).sum(axis=1), ids[local_roots(linked)]


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, caps: int = CAPS,
    members: int = MEMBERS, tile: int = TILE, seed: int = SEED,
) -> DataFrame:
    """(id, n_links long, component_id, kept): links are pairs with cosine, in double precision, of `threshold` or more;
    one row per row of `vectors`.

    The number of caps follows the number of vectors, so that a cap holds `members` on average; a cap with more than
    `tile` is compared in tiles. Pairs are counted in the first cap they share and never written out; components come
    from the links of each cap reduced to roots. Every pair that is linked is verified; a pair with cosine near the
    threshold shares no cap with a small probability (a recall above 0.99 is tested). Vectors that are null, empty, zero
    or hold null or non-finite components, and rows with a null id, link with nothing; vectors of different lengths do not
    link. Ids tell vectors apart: equal rows are one vector and get its result. An empty table gives an empty result."""
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    n = rows.count()
    wanted = max(64, -(-n * caps // members))
    blocks = 2 if wanted <= _CENTRES_BY_TWO else 3
    size = math.ceil(wanted ** (1 / blocks))

    def decode(batches):
        for batch in batches:
            ids, units, found = [], [], []
            for i, v in zip(batch["_id"].to_pylist(), batch["_v"]):
                v = np.array(v.values, float) if v.is_valid else np.zeros(0)  # nulls become nan
                largest = np.abs(v).max() if len(v) else 0.0
                if i is None or not np.isfinite(largest) or largest == 0:
                    continue
                v = v / largest
                v = v / np.linalg.norm(v)
                shape = (len(v), min(blocks, len(v)), size, seed)
                numbers = caps_of(v, directions(*shape), cap_edge(*shape, caps), caps // 2)
                ids.append(i), units.append(v), found.append(numbers)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(units, pa.list_(pa.float64())), pa.array(found, pa.list_(pa.int64()))], ["_id", "unit", "caps"],
            )

    held = durable(rows.mapInArrow(decode, "_id long, unit array<double>, caps array<long>"))
    spread = held.select("_id", "unit", "caps", F.size("unit").alias("dim"), F.explode("caps").alias("cap"))
    sizes = durable(spread.groupBy("dim", "cap").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    tiles = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    parted = spread.join(sizes, ["dim", "cap"]).withColumn("tiles", tiles).withColumn("part", F.pmod(F.xxhash64("_id"), F.col("tiles")).cast("int"))
    # part p meets every other part: tile (a, b) holds the parts a and b, a <= b
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = parted.select("dim", "cap", "_id", "unit", "caps", "part", other.alias("other"))
    dealt = dealt.select("dim", "cap", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "_id", "unit", "caps", "part")

    def tile_links(key, table):
        _, cap, a, b = (k.as_py() for k in key)
        ids, first = np.unique(table["_id"].to_numpy(), return_index=True)
        table = table.take(pa.array(first))
        units = table["unit"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        lists = table["caps"].combine_chunks()
        flat, offsets = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
        own = [flat[s:e] for s, e in zip(offsets[:-1], offsets[1:])]
        counts, roots = compared(ids, units, own, table["part"].to_numpy() if a != b else None, cap, threshold)
        some = (counts > 0) | (roots != ids)
        return pa.table({"_id": pa.array(ids[some]), "links": pa.array(counts[some].astype(np.int64)), "root": pa.array(roots[some])})

    found = durable(dealt.groupBy("dim", "cap", "a", "b").applyInArrow(tile_links, "_id long, links long, root long"))
    counted = found.groupBy("_id").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("_id").alias("a"), F.col("root").alias("b")))
    result = durable(counted.join(joined, counted["_id"] == joined["node"], "full").select(F.coalesce("_id", "node").alias("_key"), "links", "component"))
    release(held, sizes, found)
    component = F.coalesce("component", "_id")
    return vectors.select(F.col(id_col).cast("long").alias("_id")).join(result, F.col("_id") == F.col("_key"), "left").select(
        F.col("_id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"),
    )
