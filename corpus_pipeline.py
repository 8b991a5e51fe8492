"""A corpus pipeline over the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qhapaq.llm import dedup, mixing, packing, quality, secret_scan
from qhapaq.shared import ship, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject."""
    judged = quality.judge(docs, public_tokenizers.path("piece_bpe_32k.model"), second_path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return judged.filter("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group: five-word shingles, similarity 0.8 or more."""
    return dedup.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put [SECRET] in the place of every secret."""
    cleaned = secret_scan.scan(docs, redact="[SECRET]").select("row.*")
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix sources to weights 3, 1, 2, repeating; a document taken more than once is there as many times."""
    _, mixed = mixing.mix(docs, mixing.in_turn(3, 1, 2))
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    return (mixed.select("row", times.alias("times")).filter("times > 0")
            .select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("row.*"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut what is left into sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality rules", quality_rules), ("MinHash near-dedup", near_dedup), ("secret scans", secrets),
          ("mixing sources to target weights", mix), ("packing", pack)]
#: Tokeniser bands, the network and the packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES in order to the documents table; each stage is written before the next reads it."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
    return docs
