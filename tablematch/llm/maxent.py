"""Language-model scores: a hashed maximum-entropy model with classes of words.

P(word | text before) = P(class | text before) * P(word | class). The first is a softmax over few classes whose scores are
sums of rows of one weight table; the rows are chosen by hashes of the words before: each of the last three (the farther
two are skips) and the last two together. The second comes from counts. Frequent words are classes of their own, others
are grouped by how they end. Word counts and the sums that need them are joins on words; only tables of a fixed size are
collected and sent to the executors: the most frequent words, the class sums and the weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablematch.llm.common import batch_words, hashes, mixed, slices
from tablematch.plans.skew import durable, release

#: Classes of single words (the end of a text is the first), classes by ending, and rows of the weight table.
OWN, ENDINGS, ROWS = 32, 32, 1 << 15
#: The most words whose counts every executor holds, and of them those that are told apart in the text before.
FREQUENT, CONTEXT, ENDING_BITS = 65_536, 4096, 10
#: One token in so many trains; rounds of updates; tasks of a round; step and batch of an update.
EVERY, ROUNDS, TASKS, STEP, BATCH = 1, 3, 128, 0.15, 1024
#: Bytes of text that a task takes apart at a time.
SLICE = 1 << 20
_END = hashes([b""])[0]
_START = np.uint64(0xA5A5A5A5A5A5A5A5)


def endings(distinct: list[bytes]) -> np.ndarray:
    """Hash of the last three bytes of each word, punctuation aside."""
    return (hashes([(w.rstrip(b".,;:!?") or w)[-3:] for w in distinct], 7) >> np.uint64(64 - ENDING_BITS)).astype(np.int64)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a batch with an end after each text, their endings, their text, and their place in it."""
    codes, bounds, distinct = batch_words(texts, lower=True)
    n_texts = len(bounds) - 1
    at = np.arange(len(codes)) + np.repeat(np.arange(n_texts), np.diff(bounds))
    word = np.full(len(codes) + n_texts, _END)
    ending = np.zeros(len(codes) + n_texts, np.int64)
    if len(codes):
        word[at], ending[at] = hashes(distinct)[codes], endings(distinct)[codes]
    lengths = np.diff(bounds) + 1
    starts = np.r_[0, np.cumsum(lengths)][:-1]
    text = np.repeat(np.arange(n_texts), lengths)
    return word, ending, text, np.arange(len(word)) - starts[text]


@dataclass(frozen=True)
class Counts:
    """Frequent words in order of their hash, with count and rank; sums by class; all tokens and distinct words."""

    words: np.ndarray
    counts: np.ndarray
    ranks: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    n: int
    v: int

    def known(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (0 where it is not held here) and rank (-1)."""
        if not len(self.words):
            return np.zeros(len(word), np.int64), np.full(len(word), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        held = self.words[at] == word
        return np.where(held, self.counts[at], 0), np.where(held, self.ranks[at], -1)

    def classes(self, word: np.ndarray, ending: np.ndarray, rank: np.ndarray) -> np.ndarray:
        own = (rank >= 0) & (rank < OWN - 1)
        return np.where(word == _END, 0, np.where(own, rank + 1, OWN + ending % ENDINGS))

    def features(self, word: np.ndarray, ending: np.ndarray, place: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Rows of the weight table for each token, from the words before it."""
        symbol = np.where((rank >= 0) & (rank < CONTEXT), rank, CONTEXT + ending).astype(np.uint64)

        def before(x: np.ndarray, k: int) -> np.ndarray:
            out = np.full(len(x), _START)
            out[k:] = np.where(place[k:] >= k, x[:-k] if k else x, _START)
            return out

        with np.errstate(over="ignore"):
            one, two = before(word, 1), before(word, 2)
            keys = [
                before(symbol, 1) + np.uint64(1 << 40), before(symbol, 2) + np.uint64(2 << 40), before(symbol, 3) + np.uint64(3 << 40),
                one * np.uint64(0x9E3779B97F4A7C15) + two,
            ]
        return np.stack([(mixed(k) % np.uint64(ROWS)).astype(np.int32) for k in keys], axis=1)


def softmax(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Probabilities of the classes, one line per token."""
    scores = weights[rows[:, 0]] + bias
    for k in range(1, rows.shape[1]):
        scores += weights[rows[:, k]]
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def row_sums(gradient: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and the sum of the lines of `gradient` that name each. The second, third, ... lines of all rows are
    added at once, the rest of a frequent row in one piece."""
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")
    starts = np.flatnonzero(np.r_[True, flat[order[1:]] != flat[order[:-1]]])
    n = np.diff(np.r_[starts, len(flat)])
    by_size, line, most = np.argsort(-n, kind="stable"), order // rows.shape[1], 16
    first, n = starts[by_size], n[by_size]
    sums = gradient[line[first]]
    for k in range(1, most):
        live = np.searchsorted(-n, -k, "left")
        if not live:
            break
        sums[:live] += gradient[line[first[:live] + k]]
    for i in range(np.searchsorted(-n, -most, "left")):
        sums[i] += gradient[line[first[i] + most:first[i] + n[i]]].sum(axis=0)
    return flat[order[first]], sums


def updated(weights: np.ndarray, squares: np.ndarray, bias: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> None:
    """One gradient step on a batch, in place; each weight's step falls with the squares of its gradients."""
    gradient = softmax(weights, bias, rows)
    gradient[np.arange(len(rows)), classes] -= 1
    touched, sums = row_sums(gradient, rows)
    scale = squares[touched] + sums**2
    squares[touched] = scale
    weights[touched] -= STEP * sums / np.sqrt(scale + 1)


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, ending, c): how often each token stands in `_text`."""

    def count(batches):
        for batch in slices(batches, "_text", SLICE):
            word, ending, _, _ = tokens(batch["_text"])
            distinct, first, n = np.unique(word, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(ending[first]), pa.array(n)], ["word", "ending", "n"])

    return rows.select("_text").mapInArrow(count, "word long, ending long, n long").groupBy("word", "ending").agg(F.sum("n").alias("c"))


def collected(counts: DataFrame) -> Counts:
    """The tables of fixed size that every executor holds."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    words_only = counts.where(F.col("word") != int(_END.view(np.int64))).withColumn("level", F.floor(F.log2("c") * 8))
    # the counts from which words are frequent: a limit would send as many rows from every partition
    least, n_top = 1 << 30, 0
    for r in sorted(words_only.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.level):
        n_top += r.n
        if n_top > FREQUENT:
            break
        least = r.level
    top = words_only.where(F.col("level") >= least).select("word", "ending", "c").toPandas()
    top = top.sort_values(["c", "word"], ascending=[False, True], ignore_index=True)
    by_ending = words_only.groupBy((F.col("ending") % ENDINGS).alias("k")).agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")
    ).collect()
    words, own = top["word"].to_numpy(np.int64).view(np.uint64), top.iloc[:OWN - 1]
    tokens_, words_ = np.zeros(OWN + ENDINGS), np.zeros(OWN + ENDINGS)
    for r in by_ending:
        tokens_[OWN + r.k], words_[OWN + r.k] = r.n, r.v
    for i, (e, c) in enumerate(zip(own["ending"], own["c"])):
        tokens_[OWN + e % ENDINGS] -= c
        words_[OWN + e % ENDINGS] -= 1
        tokens_[1 + i] = c
    tokens_[0] = max(0, total.n - tokens_.sum())
    order = np.argsort(words)
    return Counts(words[order], top["c"].to_numpy(np.int64)[order], order, tokens_, words_, int(total.n), int(total.v))


def examples(rows: DataFrame, counts: Counts, every: int, rounds: int) -> DataFrame:
    """(round, rows, classes): all tokens of `_text` (a hashed share of them if `every` is above 1), dealt to rounds, as packed arrays."""
    held = rows.sparkSession.sparkContext.broadcast(counts)

    def pick(batches):
        c = held.value
        for batch in slices(batches, "_text", SLICE):
            word, ending, text, place = tokens(batch["_text"])
            key = batch["_h"].to_numpy().view(np.uint64)[text]
            with np.errstate(over="ignore"):
                draw = mixed(key + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(every * rounds)
            _, rank = c.known(word)
            features, classes = c.features(word, ending, place, rank).astype(np.uint16), c.classes(word, ending, rank).astype(np.uint8)
            for r in range(rounds):
                some = np.flatnonzero(draw == r)
                if len(some):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r], pa.int32()), pa.array([features[some].tobytes()], pa.binary()), pa.array([classes[some].tobytes()], pa.binary())],
                        ["round", "rows", "classes"],
                    )

    return rows.mapInArrow(pick, "round int, rows binary, classes binary")


def trained(spark: SparkSession, table: DataFrame, bias: np.ndarray, rounds: int, tasks: int) -> np.ndarray:
    """The weights after `rounds` rounds. In each round tasks make gradient steps on their share of examples, from the
    weights of the round before; each row of the next weights is the mean of the tasks' rows, by how often they used it."""
    weights = np.zeros((ROWS, len(bias)), np.float32)
    for r in range(rounds):
        sent = spark.sparkContext.broadcast((weights, bias))

        def descend(batches):
            start, b = sent.value
            own, squares, used = start.copy(), np.zeros_like(start), np.zeros(ROWS, np.int64)
            for batch in batches:
                for packed, classes in zip(batch["rows"].to_pylist(), batch["classes"].to_pylist()):
                    rows, want = np.frombuffer(packed, np.uint16).reshape(-1, 4), np.frombuffer(classes, np.uint8)
                    used += np.bincount(rows.ravel(), minlength=ROWS)
                    for i in range(0, len(rows), BATCH):
                        updated(own, squares, b, rows[i:i + BATCH], want[i:i + BATCH])
            for k in np.array_split(np.flatnonzero(used), 64):
                if len(k):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(k[0] * 64 // ROWS)], pa.int32()), pa.array([k.astype(np.int32).tobytes()], pa.binary()),
                         pa.array([used[k].astype(np.float32).tobytes()], pa.binary()), pa.array([(own[k] * used[k, None]).astype(np.float32).tobytes()], pa.binary())],
                        ["part", "rows", "used", "sums"],
                    )

        def meet(key, parts):
            total, n = np.zeros((ROWS, len(bias)), np.float32), np.zeros(ROWS, np.float32)
            for rows, used, sums in zip(*(parts[c].to_pylist() for c in ("rows", "used", "sums"))):
                k = np.frombuffer(rows, np.int32)
                n[k] += np.frombuffer(used, np.float32)
                total[k] += np.frombuffer(sums, np.float32).reshape(len(k), -1)
            k = np.flatnonzero(n)
            return pa.table({"rows": pa.array([k.astype(np.int32).tobytes()], pa.binary()), "used": pa.array([n[k].tobytes()], pa.binary()), "sums": pa.array([total[k].tobytes()], pa.binary())})

        own = table.where(F.col("round") == r).select("rows", "classes").coalesce(tasks)
        parts = own.mapInArrow(descend, "part int, rows binary, used binary, sums binary")
        found = durable(parts.groupBy("part").applyInArrow(meet, "rows binary, used binary, sums binary"))
        total, n = np.zeros_like(weights), np.zeros(ROWS, np.float32)
        for row in found.collect():  # as large as the weights
            k = np.frombuffer(row.rows, np.int32)
            n[k] += np.frombuffer(row.used, np.float32)
            total[k] += np.frombuffer(row.sums, np.float32).reshape(len(k), -1)
        some = n > 0
        weights[some] = total[some] / n[some, None]
        sent.unpersist()
        release(found)
    return weights


def score_texts(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY, rounds: int = ROUNDS,
    tasks: int = TASKS,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of whole texts.

    The model learns from the rows where `held_out` is false (null counts as false). Tokens are the words, A-Z lower-cased,
    and one end. `base_score` adds log10((c + 1) / (N + V + 1)) for the tokens, c being a token's count in training, N all
    tokens and V the distinct ones; `score` is that of the model, `n_known` the tokens with c > 0. Counts are of all
    training texts; each token trains the weights in one round
    (one in `every` of them, if that is above 1). Null and empty texts are one end. Repeated
    rows and null ids get a row each. Without training rows N is 0 and all words of a class are alike. An empty table
    gives an empty result; other columns than id, text and those of `held_out` are not read."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(held_out, F.lit(False)).alias("_held"), text.alias("_text"))
    train = rows.where(~F.col("_held"))
    table = durable(word_counts(train))
    counts = collected(table)
    shown = durable(examples(train.select(F.xxhash64("_text").alias("_h"), "_text"), counts, every, rounds))
    bias = np.log(counts.class_tokens + 1).astype(np.float32)
    weights = trained(spark, shown, bias, rounds, tasks)
    release(shown)
    model = spark.sparkContext.broadcast((counts, weights, bias))
    id_type = rows.schema["_id"].dataType.simpleString()

    def score(batches):
        counts, weights, bias = model.value
        share = np.log10(counts.class_tokens + counts.class_words + 1)
        share[:OWN] = 0
        for batch in slices(batches, "_text", SLICE):
            word, ending, text, place = tokens(batch["_text"])
            count, rank = counts.known(word)
            rank_rows, classes = counts.features(word, ending, place, rank), counts.classes(word, ending, rank)
            chances = np.empty(len(word))
            for i in range(0, len(word), 8192):
                p = softmax(weights, bias, rank_rows[i:i + 8192])
                chances[i:i + 8192] = p[np.arange(len(p)), classes[i:i + 8192]]
            local = np.log10(np.maximum(chances, 1e-30)) - share[classes]
            ends = word == _END
            held = (rank >= 0) | ends  # the end's count is known too: it is a class of its own
            count = np.where(ends, int(counts.class_tokens[0]), count)
            logs = np.where(held, np.log10(count + 1.0), 0)
            n = batch.num_rows
            rare = np.flatnonzero(~held)
            pair = np.stack([text[rare].astype(np.uint64), word[rare]], axis=1)
            order = np.lexsort((pair[:, 1], pair[:, 0]))
            pair = pair[order]
            new = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]).any(axis=1)]) if len(pair) else np.zeros(0, np.int64)
            times = np.diff(np.r_[new, len(pair)])
            offsets = np.searchsorted(pair[new, 0], np.arange(n + 1).astype(np.uint64)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (pair[new, 1].view(np.int64), times.astype(np.int32))]
            sums = [np.bincount(text, weights=w, minlength=n) for w in (logs, np.where(classes >= OWN, logs, 0), local)]
            yield pa.RecordBatch.from_arrays(
                [batch["_id"], batch["_held"], pa.array(np.bincount(text, minlength=n)), pa.array(np.bincount(text, weights=held & (count > 0), minlength=n).astype(np.int64)),
                 *[pa.array(s) for s in sums], *lists], ["_id", "_held", "n_tokens", "n_here", "logs", "own_logs", "local", "rare", "times"],
            )

    schema = f"_id {id_type}, _held boolean, n_tokens long, n_here long, logs double, own_logs double, local double, rare array<long>, times array<int>"
    scored = durable(rows.mapInArrow(score, schema).withColumn("_row", F.monotonically_increasing_id()))
    # counts of the words that executors do not hold
    found = scored.select("_row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("_row", F.col("x.rare").alias("word"), "x.times")
    joined = found.join(table.select("word", "c"), "word")
    more = joined.groupBy("_row").agg(F.sum("times").alias("n_there"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("there"))
    there = F.coalesce("there", F.lit(0.0))
    return scored.drop("rare", "times").join(more, "_row", "left").select(
        F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "n_tokens", (F.col("n_here") + F.coalesce("n_there", F.lit(0))).alias("n_known"),
        F.lit(counts.n).cast("long").alias("train_tokens"),
        (F.col("logs") + there - F.col("n_tokens") * F.lit(float(np.log10(counts.n + counts.v + 1)))).alias("base_score"),
        (F.col("local") + F.col("own_logs") + there).alias("score"),
    )
