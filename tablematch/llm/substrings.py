"""Exact removal of repeated passages: suffix trees over groups of windows that fit in memory.

A window of `window` words is a suffix cut at that depth; passages repeat where two windows end in the same node. To
ship each text about once and not once per suffix, the suffixes are not split by their first words but by the prefix
that consecutive windows share: the smallest hash of `prefix` words inside the window, which equal windows have in
common. Consecutive windows with one such prefix form a run and travel together. Groups of one run have no
inner node and are dropped before any text moves. Equal runs are one leaf with a count. A group with more than `group`
different runs gets its prefix lengthened to the whole window, where nodes are plain counts, combined before the
shuffle; so no group has to fit in one task, whatever the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tablematch.llm.common import batch_words, hashes, keyed, mixed, same_key, slices
from tablematch.plans.skew import durable, release

WINDOW, PREFIX, GROUP = 35, 8, 20_000
_FACTOR = 0x9E3779B97F4A7C15
_WORDS_AT_ONCE = 1 << 20


def _combined(x: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` values from each place on, by doubling."""
    with np.errstate(over="ignore"):
        out, done = x, 1
        while done < length:
            step = min(done, length - done)
            n = max(0, len(x) - done - step + 1)
            out = out[:n] * np.uint64(pow(_FACTOR, step, 1 << 64)) + out[step:step + n]
            done += step
        return mixed(out)


def _least(x: np.ndarray, length: int) -> np.ndarray:
    out, done = x, 1
    while done < length:
        step = min(done, length - done)
        n = max(0, len(x) - done - step + 1)
        out = np.minimum(out[:n], out[step:step + n])
        done += step
    return out


def _repeats_near(x: np.ndarray, reach: int) -> np.ndarray:
    """Whether the value of a place comes again within `reach`."""
    out = np.zeros(len(x), bool)
    for step in range(1, min(reach, len(x) - 1) + 1):
        out[:-step] |= x[:-step] == x[step:]
    return out


def window_runs(values: np.ndarray, bounds: np.ndarray, window: int, prefix: int):
    """Runs of consecutive windows of one text that share their least prefix: (prefix hash, text, first window, number
    of windows, whether the run can hold a window twice)."""
    n = len(values) - window + 1
    if n <= 0:
        return [np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, bool)]
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    grams = _combined(values, prefix)
    least = _least(grams, window - prefix + 1)[:n]
    places = np.flatnonzero(np.arange(n) + window <= bounds[text[:n] + 1])
    if not len(places):
        return [np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, bool)]
    new = np.r_[True, (np.diff(places) > 1) | (np.diff(text[places]) > 0) | (least[places][1:] != least[places][:-1])]
    heads, counts = places[new], np.diff(np.r_[np.flatnonzero(new), len(places)])
    near = np.r_[0, np.cumsum(_repeats_near(grams, window - prefix))]
    last = np.minimum(heads + counts - 1 + window - prefix + 1, len(grams))
    twice = (near[last] > near[heads]) | (counts > window - prefix + 1)
    return least[heads], text[heads], heads - bounds[text[heads]], counts, twice


def repeated(codes: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows that stand at two places or more. `codes`: words, `ends`: for each place the end of its
    text. The tree is built down from the root, depth doubled each time; nodes with one leaf are not entered."""
    places, names, depth = np.arange(len(codes)), codes, 1
    while depth < window:
        step = min(depth, window - depth)
        at = np.full(len(codes), -1, np.int64)
        at[places] = names
        places = places[places + depth + step <= ends[places]]
        left, right = at[places], at[places + step]
        open_ = (left >= 0) & (right >= 0)
        places = places[open_]
        if not len(places):
            break
        _, names, counts = np.unique(left[open_] * len(codes) + right[open_], return_inverse=True, return_counts=True)
        several = counts[names] > 1
        places, names = places[several], names[several]
        depth += step
    return places


def _covered(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Spans (start, end) that windows at `starts` (ascending) cover."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.r_[True, np.diff(starts) > window])
    return [(int(starts[a]), int(starts[b - 1]) + window) for a, b in zip(new, [*new[1:], len(starts)])]


def _stretch_marks(grams, bodies, window: int) -> list[list[tuple[int, int]]]:
    codes, bounds, _ = batch_words(pa.array(bodies, pa.string()))
    ends = np.repeat(bounds[1:], np.diff(bounds))
    starts = repeated(codes, ends, window)
    cuts = np.searchsorted(starts, bounds)
    return [_covered(starts[a:b] - s, window) for a, b, s in zip(cuts[:-1], cuts[1:], bounds[:-1])]


def repeated_spans(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """(_id, _h, spans): word spans of the texts of `docs` (see `keyed`) that repeated windows cover."""
    id_type = docs.schema["_id"].dataType.simpleString()
    runs_type = f"_id {id_type}, _h long, gram long, first int, n int, weight int"

    def runs(batches):
        for batch in slices(batches, "_text"):
            codes, bounds, distinct = batch_words(batch["_text"])
            gram, text, first, n, twice = window_runs(mixed(hashes(distinct))[codes] if len(codes) else np.zeros(0, np.uint64), bounds, window, prefix)
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch["_id"].take(at), batch["_h"].take(at), pa.array(gram.view(np.int64)), pa.array(first.astype(np.int32)),
                 pa.array(n.astype(np.int32)), pa.array(1 + twice.astype(np.int32))], ["_id", "_h", "gram", "first", "n", "weight"],
            )

    # which runs have company
    all_runs = docs.mapInArrow(runs, runs_type)
    # a table of one row per group, so that the join can split a group with very many runs
    grams = durable(all_runs.groupBy("gram").agg(F.sum("weight").alias("leaves")).where("leaves > 1").select("gram"))
    shared = all_runs.join(grams, "gram", "left_semi")
    wanted = durable(shared.groupBy("_id", "_h").agg(F.collect_set(F.struct("first", "n", "gram")).alias("runs")))
    release(grams)

    def stretches(batches):
        for batch in slices(batches, "_text", 1 << 20):
            ids, hs, grams, firsts, ns, bodies = [], [], [], [], [], []
            for i, (text, runs) in enumerate(zip(batch["_text"].cast(pa.binary()).to_pylist(), batch["runs"].to_pylist())):
                parts = text.split()
                for run in runs:
                    ids.append(i)
                    grams.append(run["gram"])
                    firsts.append(run["first"])
                    bodies.append(b" ".join(parts[run["first"]:run["first"] + run["n"] + window - 1]))
            at = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["_id"].take(at), batch["_h"].take(at), pa.array(grams, pa.int64()), pa.array(firsts, pa.int32()),
                 pa.array(bodies, pa.binary()).cast(pa.string())], ["_id", "_h", "gram", "first", "body"],
            )

    # the text of those runs, equal ones once
    texts = docs.join(wanted, same_key(docs, wanted)).select(docs["_id"], docs["_h"], "_text", "runs")
    found = texts.mapInArrow(stretches, f"_id {id_type}, _h long, gram long, first int, body string")
    found = durable(found.withColumn("leaf", F.xxhash64("body")))
    leaves = durable(found.groupBy("gram", "leaf", "body").agg((F.count(F.lit(1)) > 1).alias("several")))
    release(wanted)

    spans_type = "gram long, leaf long, spans array<struct<start:int,end:int>>"
    sizes = leaves.groupBy("gram").agg(F.count(F.lit(1)).alias("size"))
    large = durable(sizes.where(F.col("size") > group).select("gram"))

    def subtrees(batches):
        held, n = [], 0

        def done(rows):
            spans = _stretch_marks(rows["gram"], rows["body"].to_pylist(), window)
            whole = rows["several"].to_pylist()
            lengths = [b.count(" ") + 1 for b in rows["body"].to_pylist()]
            spans = [[(0, k)] if w else s for s, w, k in zip(spans, whole, lengths)]
            return pa.RecordBatch.from_arrays(
                [rows["gram"].combine_chunks(), rows["leaf"].combine_chunks(), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans],
                 pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["gram", "leaf", "spans"],
            )

        for batch in batches:
            held.append(batch)
            n += batch["body"].nbytes
            if n > 8 * _WORDS_AT_ONCE:
                rows = pa.Table.from_batches(held)
                last = rows["gram"][-1].as_py()
                cut = pc.index(rows["gram"], last).as_py()  # the last group may go on
                if cut:
                    yield done(rows.slice(0, cut))
                    held = rows.slice(cut).to_batches()
                    n = sum(b["body"].nbytes for b in held)
        if held:
            yield done(pa.Table.from_batches(held))

    small = leaves.join(large, "gram", "left_anti").repartition("gram").sortWithinPartitions("gram")
    marks = small.mapInArrow(subtrees, spans_type).where("size(spans) > 0")

    def windows(batches):
        for batch in slices(batches, "body", 1 << 20):
            codes, bounds, distinct = batch_words(batch["body"])
            a, b = (_combined(mixed(hashes(distinct, s))[codes], window) for s in (1, 2))
            text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:len(a)]
            places = np.flatnonzero(np.arange(len(a)) + window <= bounds[text + 1])
            at = pa.array(text[places])
            yield pa.RecordBatch.from_arrays(
                [batch["gram"].take(at), batch["leaf"].take(at), pc.add(batch["several"].take(at).cast(pa.int32()), 1).cast(pa.int32()),
                 pa.array((places - bounds[text[places]]).astype(np.int32)), pa.array(a[places].view(np.int64)),
                 pa.array(b[places].view(np.int64))], ["gram", "leaf", "weight", "at", "a", "b"],
            )

    if not large.isEmpty():
        nodes = leaves.join(large, "gram", "left_semi").mapInArrow(windows, "gram long, leaf long, weight int, at int, a long, b long")
        inner = durable(nodes.groupBy("a", "b").agg(F.sum("weight").alias("leaves")).where("leaves > 1").select("a", "b"))
        span = F.struct(F.col("at").alias("start"), (F.col("at") + window).alias("end"))
        deep = nodes.join(inner, ["a", "b"], "left_semi").groupBy("gram", "leaf").agg(F.collect_list(span).alias("spans"))
        marks = marks.union(deep)
    marks = durable(marks)
    release(leaves)
    at = found.drop("body").join(marks, ["gram", "leaf"])
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("first")).alias("start"), (s["end"] + F.col("first")).alias("end")))
    # equal rows of docs bring each span twice, which does no harm
    return at.withColumn("spans", moved).groupBy("_id", "_h").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP,
) -> DataFrame:
    """(id, n_words, n_removed, kept_text): each text without the words that lie in a window of `window` words which
    starts anywhere else too, in another text or in the same. All copies go, the first included; windows are judged on
    the texts as given. Kept words are joined by one space. One row per row of `docs`: repeated rows are copies of each
    other. Null and empty texts and texts below `window` words lose nothing; ids may be null; other columns are not read."""
    if not 0 < prefix <= window:
        raise ValueError("the prefix is one word at least and at most the window")
    rows = keyed(docs, id_col, text_col)
    spans = durable(repeated_spans(rows, window, prefix, group))
    id_type = rows.schema["_id"].dataType.simpleString()

    def cut(batches):
        for batch in slices(batches, "_text"):
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(batch["_text"].cast(pa.binary()).to_pylist(), batch["spans"].to_pylist()):
                parts = text.split()
                change = np.zeros(len(parts) + 1, np.int64)
                for s in spans or ():
                    change[s["start"]] += 1
                    change[s["end"]] -= 1
                stays = np.cumsum(change[:-1]) == 0
                n_words.append(len(parts))
                n_removed.append(int(len(parts) - stays.sum()))
                kept.append(b" ".join([w for w, k in zip(parts, stays.tolist()) if k] if spans else parts))
            yield pa.RecordBatch.from_arrays(
                [batch["_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["_id", "n_words", "n_removed", "kept_text"],
            )

    both = rows.join(spans, same_key(rows, spans), "left").select(rows["_id"], "_text", "spans")
    out = both.mapInArrow(cut, f"_id {id_type}, n_words long, n_removed long, kept_text string")
    return out.select(F.col("_id").alias(id_col), "n_words", "n_removed", "kept_text")
