"""Corpus pipeline: raw documents to packed training sequences, one operator per stage.

Every stage reads its predecessor's rows from Parquet, works on all of them and, but for the last,
returns the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleval.llm import line_dedup, mixing, near_dedup, packing, toxicity
from tripleval.session import scratch_path, ship_package, write_table

# Least similarity of near duplicates, in percent, on five-word shingles; the query op6 has its own (85).
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from the table ``labels``."""
    ship_package(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of three-line windows seen before; n_chars follows the text."""
    out = line_dedup.drop_repeated_lines(docs)
    left = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", left).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, at a similarity of NEAR_PERCENT or more."""
    ship_package(spark)
    return near_dedup.drop_near_duplicates(docs, NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in the proportions of the source weights, repeated where the mix repeats them."""
    return mixing.mix_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; a document that the mix repeats is packed each time."""
    ship_package(spark)
    pieces = write_table(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces")
    return packing.pack(pieces)


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("near dedup", dedup_near), ("source mix", mix_sources),
          ("best-fit packing", best_fit_packing)]

# SQL cannot express the trained classifier; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read back as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
