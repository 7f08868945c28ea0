"""Quality by importance resampling: how much likelier a text is under good texts than under the corpus.

Both are bags of hashed words and word pairs. The corpus model counts all documents; the model of good texts counts a
bounded sample of labelled ones. The log weight of a text sums over its words and pairs, so it grows with length; what
decides is its level: the mean per word and pair, times their number in a corpus text of mean length. Documents are drawn
by Gumbel top-k: of level plus Gumbel noise the k largest, k being the number of documents whose level is at least that
of good ones held out from the fit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablematch.llm.common import batch_words, hashes, mixed, slices
from tablematch.plans.skew import durable, release
from tablematch.sources.ordinal import with_ordinal_by

BITS, SAMPLE, PRIOR, LOST, SEED = 17, 20_000, 4.0, 0.002, 23


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of a batch, and the text of each."""
    codes, bounds, distinct = batch_words(texts, lower=True)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    single = mixed(hashes(distinct))[codes]
    with np.errstate(over="ignore"):
        pair = mixed(single[:-1] * np.uint64(0x9E3779B97F4A7C15) + single[1:])
    inside = text[1:] == text[:-1]
    both = np.r_[single, pair[inside]] >> np.uint64(64 - bits)
    return both.astype(np.int64), np.r_[text, text[1:][inside]]


@dataclass(frozen=True)
class QualityModel:
    """Log ratio by bucket, the Gumbel seed, words and pairs of a text of mean length, and the smallest noisy level that is
    drawn (None: none is)."""

    ratios: np.ndarray
    seed: int
    length: float
    cut: float | None = None

    def weight(self, text_col: str) -> Column:
        """Log weight and level of each text; null for texts without words."""
        ratios, bits, length = self.ratios, len(self.ratios).bit_length() - 1, self.length
        kind = pa.struct([("weight", pa.float64()), ("level", pa.float64())])

        @F.arrow_udf("weight double, level double")
        def of(texts: pa.Array) -> pa.Array:
            out = []
            for part in slices([pa.RecordBatch.from_arrays([texts], ["t"])], "t"):
                bucket, text = features(part["t"], bits)
                n = np.bincount(text, minlength=part.num_rows)
                sums = np.bincount(text, weights=ratios[bucket], minlength=part.num_rows)
                both = [pa.array(x, pa.float64(), mask=n == 0) for x in (sums, sums / np.maximum(n, 1) * length)]
                out.append(pa.StructArray.from_arrays(both, fields=list(kind)))
            return pa.concat_arrays(out) if out else pa.array([], kind)

        return of(F.coalesce(F.col(text_col).cast("string"), F.lit("")))

    def noisy(self, level: Column, id_col: str) -> Column:
        """Level plus standard Gumbel noise that is a hash of seed and id."""
        u = (F.xxhash64(F.lit(self.seed), F.col(id_col)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / F.lit(2.0**52)
        return level - F.log(-F.log(u))

    def scored(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """`docs` with `_weight`, `_level` and `_noisy`."""
        both = docs.withColumn("_both", self.weight(text_col))
        both = both.withColumn("_weight", F.col("_both.weight")).withColumn("_level", F.col("_both.level")).drop("_both")
        return both.withColumn("_noisy", self.noisy(F.col("_level"), id_col))

    def drawn(self) -> Column:
        return F.coalesce(F.col("_noisy") >= F.lit(self.cut), F.lit(False)) if self.cut is not None else F.lit(False)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality",
    avoid_col: str | None = "toxic", bits: int = BITS, sample: int = SAMPLE, prior: float = PRIOR, lost: float = LOST, seed: int = SEED,
) -> tuple[QualityModel, DataFrame]:
    """The model for `docs`, and (_id, _weight, _level, _noisy) of all of them.

    Good texts are labelled `quality_col` 1 and not `avoid_col` 1. Of more than `sample` labelled documents a hash of
    the ids chooses about 0.95 `sample`: of the good ones half fit the model, the other half set the level that all but a share `lost` of
    good texts reach. A bucket's ratio is (n + prior) / (expected n + prior), n the count in good texts and the expected one
    that of the corpus scaled to their length, so that a rare bucket says nothing. Without good texts all ratios are 1."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    avoid = F.lit(False) if avoid_col is None else F.coalesce(F.col(avoid_col) == 1, F.lit(False))
    known = labels.where(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull()).select(
        F.col(id_col).alias("_label"), ((F.col(quality_col) == 1) & ~avoid).alias("_good"), F.xxhash64(F.lit(seed), id_col).alias("_hash")
    )
    known = durable(known.groupBy("_label").agg(F.min("_good").alias("_good"), F.min("_hash").alias("_hash")))
    some = min(1.0, 0.95 * sample / max(1, known.count()))  # a share of all hashes; a limit would send as many rows from every task
    chosen = known.where(F.pmod(F.xxhash64("_hash"), F.lit(1 << 20)) < F.lit(int(some * (1 << 20))))
    chosen = durable(chosen.where("_good").select("_label", (F.col("_hash") % 2 == 0).alias("_fits")))
    tagged = rows.join(F.broadcast(chosen), rows["_id"] == chosen["_label"], "left")  # `sample` rows at most

    def counts(batches):
        held, texts = np.zeros((2, 1 << bits), np.int64), 0
        for batch in slices(batches, "_text"):
            bucket, text = features(batch["_text"], bits)
            held[0] += np.bincount(bucket, minlength=1 << bits)
            fits = batch["fits"].to_numpy(zero_copy_only=False)
            held[1] += np.bincount(bucket[fits[text]], minlength=1 << bits)
            texts += len(np.unique(text))
        some = np.flatnonzero(held[0])
        columns = np.r_[some, -1].astype(np.int32), np.r_[held[0][some], texts], np.r_[held[1][some], 0]  # bucket -1: texts with words
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["bucket", "raw", "good"])

    by_task = tagged.select("_text", F.coalesce("_fits", F.lit(False)).alias("fits")).mapInArrow(counts, "bucket int, raw long, good long")
    total = by_task.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()  # one row per bucket
    raw, good = np.zeros(1 << bits), np.zeros(1 << bits)
    texts, total = total.loc[total["bucket"] < 0, "raw"].sum(), total[total["bucket"] >= 0]
    raw[total["bucket"]], good[total["bucket"]] = total["raw"], total["good"]
    expected = raw * (good.sum() / max(1, raw.sum()))
    model = QualityModel(np.log((good + prior) / (expected + prior)), seed, raw.sum() / max(1, texts))
    scores = durable(model.scored(tagged.drop("_label"), "_id", "_text").drop("_text"))
    held_out = scores.where("_fits = false AND _level IS NOT NULL").agg(F.percentile_approx("_level", lost, 100_000)).first()[0]
    floor = 0.0 if held_out is None else min(0.0, held_out)  # of `sample` rows at most
    k = scores.where(F.col("_level") >= floor).count()
    if k == 0:
        return model, scores
    order = with_ordinal_by(scores.where("_noisy IS NOT NULL").select("_noisy"), [F.desc("_noisy")], "_place")
    cut = order.where(F.col("_place") == k - 1).first()["_noisy"]
    release(chosen, known)
    return QualityModel(model.ratios, seed, model.length, cut), scores


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that are drawn, with all their columns. See `classify` for odd rows."""
    model, scores = fit(docs, labels, id_col, text_col, **options)
    release(scores)
    row = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return model.scored(row, "_id", "_text").where(model.drawn()).select("_row.*")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, log_weight, noisy_weight, kept): one row per row of `docs`; the noisy weight is the level plus noise. Null, empty and blank texts have no weight and are
    not kept; equal rows get equal results, and noisy weights equal to the last that is drawn are drawn too; null ids share
    their noise; labels of ids that `docs` lacks, null labels and, of several labels, all but the worst are ignored. An
    empty table gives an empty result; other columns are not read."""
    model, scores = fit(docs, labels, id_col, text_col, **options)
    return scores.select(
        F.col("_id").alias(id_col), F.col("_weight").alias("log_weight"), F.col("_noisy").alias("noisy_weight"), model.drawn().alias("kept")
    )
