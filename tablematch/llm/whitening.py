"""Embedding whitening from exact integer statistics, by a bit-sliced scatter matrix.

Each dimension of the integer vectors, less its least value, is cut into bit planes; a plane holds one bit of 64 rows per
word. The product sum of two dimensions is the sum over pairs of planes of 2^(a+b) times the ones in the AND of both, so
that it is exact, whatever the number of rows. The sums are centred as integers; only the matrix of one entry per pair of
dimensions goes to the driver, for its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablematch.plans.skew import durable, release

SCALE, SHIFT = 64, 1_000_000
#: Values whose planes stand in memory at once, and the largest value less its dimension's least that 64-bit sums are used for.
VALUES, NARROW = 1 << 22, 1 << 31
#: Eigenvalues at or below this part of the trace are rounding of zero.
LEAST = 1e-13


def _vectors(batch: pa.RecordBatch, name: str, dims: int) -> np.ndarray:
    column = batch[name].combine_chunks() if isinstance(batch[name], pa.ChunkedArray) else batch[name]
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    """The vectors of record batches in blocks of about `VALUES` values."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(_vectors(batch, "x", dims))
        if sum(map(np.size, held)) >= VALUES:
            yield np.concatenate(held)
            held = []
    if held:
        yield np.concatenate(held)


def planes(x: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(dimension, bit, words) of the planes of non-negative `x` that hold a one; 64 rows to a word."""
    out = []
    for d in range(x.shape[1]):
        column = x[:, d].astype(np.uint64)
        for bit in range(int(column.max(initial=0)).bit_length()):
            packed = np.packbits((column >> np.uint64(bit) & np.uint64(1)).astype(np.uint8))
            out.append((d, bit, np.frombuffer(packed.tobytes().ljust(-(-len(packed) // 8) * 8, b"\0"), np.uint64)))
    return [p for p in out if p[2].any()]


def scatter(x: np.ndarray, counts: dict[tuple[int, int, int], int]) -> None:
    """Add to `counts` of (i, j, weight), i <= j, the ones in the AND of planes of `i` and `j` whose bits add up to `weight`."""
    cut = planes(x)
    if not cut:
        return
    words = np.stack([p[2] for p in cut])
    dims, bits = (np.array([p[k] for p in cut]) for k in (0, 1))
    for k, (i, bit, plane) in enumerate(cut):
        rest = slice(int(np.searchsorted(dims, i)), None)
        ones = np.bitwise_count(words[rest] & plane).sum(axis=1, dtype=np.int64)
        for j, b, n in zip(dims[rest].tolist(), bits[rest].tolist(), ones.tolist()):
            if n:
                counts[i, j, bit + b] = counts.get((i, j, bit + b), 0) + n


def _integers(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(_id, x): rows whose vector is whole, as longs. A component beyond what a long holds makes a vector no vector."""
    c = F.col(vector_col).cast("array<double>")

    def bad(v: Column) -> Column:
        return v.isNull() | F.isnan(v) | (F.abs(v) >= F.lit(float(1 << 56)))

    whole = F.col(vector_col).isNotNull() & ~F.exists(c, bad) & (F.size(c) > 0)
    x = F.transform(c, lambda v: F.floor(v * F.lit(float(SCALE))) + F.lit(SHIFT).cast("long"))
    return embeddings.where(whole).select(F.col(id_col).alias("_id"), x.alias("x"))


class Whitening:
    """What is fitted: rows `n` and sums `s` (exact integers), mean, components (columns), eigenvalues and their trace."""

    def __init__(self, n: int, s: list[int], cross: np.ndarray, most: int):
        self.n, self.s = n, s
        self.covariance = np.array([[v / (n * n) for v in row] for row in cross.tolist()], np.float64)
        values, vectors = np.linalg.eigh(self.covariance)
        order = np.argsort(-values, kind="stable")[:most]
        self.trace = float(np.trace(self.covariance))
        kept = [k for k in order if values[k] > LEAST * self.trace]
        self.values, self.vectors = values[kept], vectors[:, kept]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S: as longs where these hold it, otherwise as Python's integers."""
        high = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * self.n + max(map(abs, self.s))
        kind = np.int64 if high < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.s, kind)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        centred = (self.deviations(x) / self.n).astype(np.float64)
        return centred @ self.vectors / np.sqrt(self.values)


def fit(distinct: DataFrame, dims: int, most: int) -> Whitening | None:
    """Statistics of the rows (x) of `distinct`, each counted as often as it stands there; None without rows."""
    ends = distinct.select(F.posexplode("x").alias("d", "v")).groupBy("d")
    ends = ends.agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("n")).orderBy("d").collect()  # one row per dimension
    if not ends:
        return None
    n, least = ends[0]["n"], np.array([r["least"] for r in ends], np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int, int], int] = {}
        sums = [0] * dims
        for block in _blocks(batches, dims):
            x = block - least
            scatter(x, counts)
            more = x.sum(axis=0) if int(x.max(initial=0)) < NARROW else x.astype(object).sum(axis=0)
            sums = [a + b for a, b in zip(sums, more.tolist())]
        # sums as planes of their own, in the row of dimension -1, so that they are exact as well
        for d, total in enumerate(sums):
            counts.update({(-1, d, bit): 1 for bit in range(total.bit_length()) if total >> bit & 1})
        rows = [np.array(c, np.int64) for c in zip(*[(*k, v) for k, v in counts.items()])] or [np.zeros(0, np.int64)] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["i", "j", "weight", "ones"])

    # pairs of dimensions times weights: a bound that does not grow with the rows
    found = distinct.mapInArrow(count, "i long, j long, weight long, ones long").groupBy("i", "j", "weight").agg(F.sum("ones").alias("ones")).collect()
    cross, sums = np.zeros((dims, dims), object), [0] * dims
    for r in found:
        value = r["ones"] << r["weight"]
        if r["i"] < 0:
            sums[r["j"]] += value
        else:
            cross[r["i"], r["j"]] += value
    cross = np.triu(cross) + np.triu(cross, 1).T
    centred = n * cross - np.outer(np.array(sums, object), np.array(sums, object))  # the shift by the least values falls out
    return Whitening(n, [s + n * int(v) for s, v in zip(sums, least)], centred, most)


def identity_error(distinct: DataFrame, model: Whitening, dims: int) -> float:
    """Largest absolute entry of the covariance of the whitened rows of `distinct`, less the identity."""
    k = len(model.values)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = model.whitened(_vectors(batch, "x", dims))
            total, square = total + z.sum(axis=0), square + z.T @ z
        at = [(i, j, v) for i, row in enumerate(square.tolist()) for j, v in enumerate(row)] + [(-1, j, v) for j, v in enumerate(total.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*at)], ["i", "j", "v"])

    rows = distinct.mapInArrow(moments, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    means, square = np.zeros(k), np.zeros((k, k))
    for r in rows:
        if r["i"] < 0:
            means[r["j"]] = r["v"] / model.n
        else:
            square[r["i"], r["j"]] = r["v"] / model.n
    return float(np.abs(square - np.outer(means, means) - np.eye(k)).max())


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each whole vector and component.

    A component c of a vector becomes floor(64 c) + 1000000. Mean and covariance are those of the distinct integer
    vectors, `n` of them, exact until they are divided. Components are unit eigenvectors of the covariance from the largest
    eigenvalue on, each with the same sign for all rows; those without variance are left out, so that equal vectors, or
    one alone, give no rows. `deviation` is the squared distance from the mean times n squared; null where no long holds it.

    Vectors that are null or empty, or hold nulls, non-finite values or values of 2^56 and more (which have no long) are
    left out. Lengths should be one; if not, the most frequent counts (of these the longest) and other vectors are left out. Rows are
    handed on one for one, repeated ones and null ids too; other columns are not read. An empty table gives an empty result."""
    kept = _integers(embeddings, id_col, vector_col)
    sizes = kept.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    schema = f"id {kept.schema['_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dims = sizes["dims"] if sizes else 0
    kept = kept.where(F.size("x") == dims)
    distinct = durable(kept.select("x").distinct())
    model = fit(distinct, dims, components)
    if model is None or not len(model.values):
        release(distinct)
        return embeddings.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    error = identity_error(distinct, model, dims)
    release(distinct)
    k = len(model.values)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch, "x", dims)
            apart = model.deviations(x)
            if apart.dtype == np.int64 and float(np.abs(apart).max(initial=0)) ** 2 * dims < 1 << 62:
                squares = pa.array((apart * apart).sum(axis=1))
            else:
                far = (apart.astype(object) ** 2).sum(axis=1).tolist()
                squares = pa.array([v if v < 1 << 63 else None for v in far], pa.int64())
            count = len(x)
            each = np.repeat(np.arange(count), k)
            yield pa.RecordBatch.from_arrays([
                batch["_id"].take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)), pa.array(np.full(count * k, model.n)),
                squares.take(pa.array(each)), pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.values / model.trace, count)),
                pa.array(np.full(count * k, error)),
            ], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.mapInArrow(rows, schema).withColumnRenamed("id", id_col)
