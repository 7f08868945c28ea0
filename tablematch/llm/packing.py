"""Packing token sequences: large documents are matched in pairs, small ones best-fit the gaps.

The plan needs lengths only. How many pieces have each length is a histogram with as many bars as a sequence has tokens,
however large the corpus; the plan is made from it in whole runs of equal pieces. Each piece then finds its place by its
rank among the pieces of its length, which is counted in slices, so that a common length does not meet in one task.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablematch.llm.common import slices
from tablematch.plans.skew import durable

CAPACITY = 2048
#: Pieces of one length that are ranked in one task.
SLICE = 1_000_000


# Fixed value: how byte-level files of this kind cut texts before they merge bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids of texts by a byte-level BPE file, as the plain call `encode(text, add_special_tokens=False)` gives them.

    The merges of such a file make tokens in the order of their ids, so that the ids are ranks, by which a faster encoder of
    the same algorithm works. Texts that hold an added token of the file, or runs of white space too long for that
    encoder's pattern, go through the plain call. Files of another kind are refused."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        told = json.loads(self.plain.to_str())
        model, cutter, added = told["model"], told["pre_tokenizer"] or {}, [t["content"] for t in told["added_tokens"]]
        merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model.get("merges", ())]
        standard = cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
        if model["type"] != "BPE" or told["normalizer"] or not standard or merged != sorted(set(merged)):
            raise ValueError(f"{path} is no byte-level BPE file that cuts texts by the standard pattern")
        # bytes stand as printable characters in the file: those that are not printable follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(c): b for c, b in [*zip(shown, shown), *zip(range(256, 512), hidden)]}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = re.compile("|".join([r"\s{1000}", *map(re.escape, added)]))

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit numbers."""
        ids = self.plain.encode(text, add_special_tokens=False).ids if self.slow.search(text) else self.fast.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenized(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """(_id, piece, start, length, ids_crc32[, ids]): the pieces of each text."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches):
        for batch in slices(batches, "_text", 4 << 20):
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch["_text"].to_pylist()):
                coded = encoder(path).encode(text) + end
                n = len(coded) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    part = coded[4 * a:4 * b]
                    at.append(i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(part))
                    ids.append(part)
            columns = [batch["_id"].take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"_id {id_type}, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(pieces, schema + ", ids array<int>" * with_ids)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, pieces, first bin, pieces in each bin, offset).

    Pieces above a third of the capacity, of which two fit in a bin at most, are matched from the largest down, each with
    the largest partner that fits; that takes the fewest bins for them. Smaller pieces, the largest first, go where they
    leave the smallest gap; only then new bins are opened. Equal pieces are placed by whole runs of equal bins, so the
    work and the plan depend on the capacity, not on the number of pieces."""
    left = {s: n for s, n in histogram.items() if n > 0}
    taken, out, bins = dict.fromkeys(left, 0), [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []

    def free(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    def put(s: int, n: int, first: int, each: int, offset: int) -> None:
        out.append((s, taken[s], n, first, each, offset))
        taken[s] += n
        left[s] -= n

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large[-1]
        k = bisect_left(large, capacity - s + 1) - 1
        if k < 0:
            n = left[s]
            put(s, n, bins, 1, 0)
            free(capacity - s, bins, n)
        elif large[k] == s and left[s] > 1:
            n = left[s] // 2
            put(s, 2 * n, bins, 2, 0)
            free(capacity - 2 * s, bins, n)
        else:
            k -= large[k] == s
            t = large[k] if k >= 0 else 0
            n = min(left[s], left[t]) if t else left[s]
            put(s, n, bins, 1, 0)
            if t:
                put(t, n, bins, 1, s)
            free(capacity - s - t, bins, n)
        bins += n
        large = [x for x in large if left[x]]
    for s in sorted((s for s in left if left[s]), reverse=True):
        while left[s]:
            k = bisect_left(order, s)
            if k == len(order):
                n = -(-left[s] // (capacity // s))
                free(capacity, bins, n)
                bins += n
                continue
            gap = order[k]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[k]
            each = gap // s
            full = min(n, left[s] // each)
            if full:
                put(s, full * each, first, each, capacity - gap)
                free(gap - each * s, first, full)
            if full < n and left[s]:
                rest = left[s]
                put(s, rest, first + full, rest, capacity - gap)
                free(gap - rest * s, first + full, 1)
                full += 1
            free(gap, first + full, n - full)
    return out


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset[, ids]): the place of each piece of each document.

    A document is the ids of its text by the file `tokenizer` (see `Encoder`), which every executor must have, and `end_id`. Only longer
    ones than `capacity` are cut, into pieces of `capacity` ids of which the first may be shorter. Sequences hold
    `capacity` ids at most, without gaps from 0. A null or empty text is the end id alone; repeated rows are packed as
    often as they come; ids may be null; an empty table gives an empty result; other columns are not read."""
    pieces = durable(tokenized(docs, tokenizer, id_col, text_col, capacity, end_id, with_ids))
    counted = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `capacity` rows
    places = plan({r.length: r.n for r in counted}, capacity)
    n_slices = 1 + max([r.n for r in counted], default=0) // SLICE
    rows = pieces.withColumn("slice", F.pmod(F.xxhash64("_id", "piece", "ids_crc32"), F.lit(n_slices)))
    earlier = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("length", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "slice").orderBy("_id", "piece", "ids_crc32"))
    ranked = rows.withColumn("inside", inside - 1).join(before, ["length", "slice"]).withColumn("rank", F.col("before") + F.col("inside"))
    fields = "size long, first_rank long, n long, first_bin long, each long, first_offset long"
    table = F.broadcast(docs.sparkSession.createDataFrame(places, fields))  # a size that depends on the capacity only
    step = F.col("rank") - F.col("first_rank")
    on = (F.col("length") == F.col("size")) & (step >= 0) & (step < F.col("n"))
    return ranked.join(table, on).select(
        F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("first_bin") + F.floor(step / F.col("each"))).alias("sequence_id"),
        (F.col("first_offset") + step % F.col("each") * F.col("length")).alias("offset"), *["ids"] * with_ids,
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, of `pack(..., with_ids=True)`."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
