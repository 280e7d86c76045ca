"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), is written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``docs``. Every column but doc_id, text, source and n_chars passes untouched.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm import jaccard_forest, line_suffixes, packing, pfair_mix, quality_rules
from stratalens.llm.common import free_name, store

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules, or with a failed rule their host, reject are gone."""
    found = free_name(docs, "_quality")
    return quality_rules.judge(docs, result=found).where(f"{found}.kept").drop(found)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are gone; so is a document of which no line with a word is left."""
    found = free_name(docs, "_lines")
    cleaned = line_suffixes.dedup_lines(docs, result=found)
    shortened = F.col(f"{found}.n_removed") > 0
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(shortened, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cleaned.where(~shortened | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop(found)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document of the smallest id stays."""
    return jaccard_forest.one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order in which every run holds the sources in their target weights."""
    return pfair_mix.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, in the order in which the mixed files are read."""
    return packing.pack(docs, TOKENIZER, RANKS)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing", mixing),
    ("packing", sequences),
]

# The tokenizer of the last stage has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = store(docs)
    return docs
