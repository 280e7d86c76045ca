"""Registered queries of the operators, each over its whole table, and the SQL that some are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hilbert_ann, hilbert_shards, jaccard_forest, line_suffixes, merkle_versions, ngram_trie, oracles, packing, pfair_mix, piece_rounds, quality_rules, span_graph, spelling_fst, url_filter

SHARDS = 40
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_hilbert_ann(spark: SparkSession, folder: str) -> DataFrame:
    return hilbert_ann.nearest(_table(spark, folder, "embeddings"))


def op2_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    shards = hilbert_shards.assign_shards(_table(spark, folder, "documents"), SHARDS)
    return shards.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op3_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "source", "text")
    return quality_rules.judge(docs).select("doc_id", "source", "_quality.*")


def op4_de_bruijn_spans(spark: SparkSession, folder: str) -> DataFrame:
    spans = span_graph.remove_repeats(_table(spark, folder, "documents"))
    return spans.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_line_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    kept = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return line_suffixes.dedup_lines(docs).select("doc_id", "_lines.*", kept.alias("kept_sha256"))


def op6_jaccard_forest(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_forest.near_duplicates(_table(spark, folder, "documents"))


def op7_concatenate_and_cut(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), TOKENIZER, RANKS).drop("ids")


def op8_host_words(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(_table(spark, folder, "pages"))


def op9_ngram_trie(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_trie.train_and_score(_table(spark, folder, "documents"), order=3)


def op10_pfair_mix(spark: SparkSession, folder: str) -> DataFrame:
    return pfair_mix.interleave(_table(spark, folder, "documents"))


def op11_path_copies(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    longer = docs["n_chars"].cast("decimal(20,0)") + 1
    rows = merkle_versions.manifest(docs, {"n_chars": longer}, merkle_versions.tampered(docs["doc_id"]))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", merkle_versions.proof(rows["steps"]).alias("proof_sha256"), "folded_root", "verified"
    )


def op12_variant_machine(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_fst.spelling_variants(_table(spark, folder, "documents"))


def op13_merge_rounds(spark: SparkSession, folder: str) -> DataFrame:
    texts = piece_rounds.decode(piece_rounds.encode(_table(spark, folder, "documents"), PIECES), PIECES)
    return texts.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hilbert_ann,
        op2_hilbert_shards,
        op3_host_rules,
        op4_de_bruijn_spans,
        op5_line_suffixes,
        op6_jaccard_forest,
        op7_concatenate_and_cut,
        op8_host_words,
        op9_ngram_trie,
        op10_pfair_mix,
        op11_path_copies,
        op12_variant_machine,
        op13_merge_rounds,
    )
}
# Tokenizers, Viterbi, signatures and fitted windows have no SQL form.
ORACLES: dict[str, str] = {
    "op2_hilbert_shards": oracles.shards_sql(SHARDS),
    "op3_host_rules": oracles.RULES_SQL,
    "op4_de_bruijn_spans": oracles.SPANS_SQL,
    "op5_line_suffixes": oracles.LINES_SQL,
    "op10_pfair_mix": oracles.mix_sql(),
    "op11_path_copies": oracles.MANIFEST_SQL,
    "op12_variant_machine": oracles.VARIANTS_SQL,
}
