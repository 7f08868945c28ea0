"""One query per corpus operator, with its production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablematch.llm import caps, html, lines, manifest, maxent, mixing, packing, quality, rules, simhash, substrings, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file() -> str:
    """Place of the byte-level BPE file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_groups(documents(spark, sf_dir), n_words=4, distance=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@query
def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(documents(spark, sf_dir), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_file(), capacity=2048, end_id=0)


@query
def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(documents(spark, sf_dir)).drop("char_distance", "word_distance")


@query
def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.remove_repeated_lines(documents(spark, sf_dir), min_lines=2)


ORACLES["op1_lines"] = lines.SQL


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


ORACLES["op2_mixing"] = mixing.SQL


@query
def op5_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.95)


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"), min_bytes=0)

    def page(name: str):
        return F.regexp_extract(name, "([0-9-]+)$", 1).try_cast("long")

    return records.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers_to").alias("refers_to")
    )


ORACLES["op8_warc"] = warc.SQL


@query
def op4_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_texts(documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)


@query
def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest.merkle_manifest(documents(spark, sf_dir), found={"text": found})


ORACLES["op12_manifest"] = manifest.SQL


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=16)
