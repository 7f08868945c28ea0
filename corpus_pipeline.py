"""From raw documents to packed sequences: good documents, no repeated line runs, one of each group of near copies, sources
in equal parts, best-fit sequences. Each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablematch.llm import lines, mixing, packing, quality, simhash
from tablematch.llm.queries import tokenizer_file
from tablematch.plans.skew import durable


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling draws; all others go."""
    return quality.quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of runs of two lines or more; `n_chars` follows the text."""
    out = lines.dedup_lines(docs, min_lines=2)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, four differing bits or fewer."""
    return simhash.keep_one(docs, n_words=5, distance=4)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out at random, so that all sources have as many characters."""
    return mixing.mix(docs).drop("copy")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_file(), capacity=2048, end_id=0)


STAGES = [
    ("quality", good_documents),
    ("line_dedup", distinct_lines),
    ("near_dedup", distinct_documents),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

#: The first stage fits a model and the last reads a tokenizer file, which SQL cannot do.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
