"""The thin queries over documents: each reads whole tables, applies one operator with production parameters and shapes its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import byte_bpe, delta_lloyd, filter_audit, line_dedup, mixing, ngram_jaccard, ngram_lm, order_minhash, quality_classifier, quality_rules, sharding, simhash, suffix_dedup
from quernstone.llm.common import read, text_or_empty, words


def vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pattern of the public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.size(words(text_or_empty("text"))).cast("long").alias("words"))
    mixed = mixing.mix(docs, mixing.production_path(), mixing.PRODUCTION_WEIGHTS, F.col("words"))
    return mixed.select("doc_id", "domain", "language", "origin", "epoch", "n_tokens")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are sources; a source's languages are its paths."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    return quality_classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), F.col("source"), path)


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.with_edits(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each occurrence of a line with where that line stands first, and one for each pair of linked lines."""
    return line_dedup.members_and_pairs(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *quality_rules.METRICS, "base_failed", "kept")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents").select("doc_id"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(read(spark, sf_dir, "documents"), *vocabulary())


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.perplexity_scores(read(spark, sf_dir, "documents"), repeatable=True)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(read(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_lloyd.cluster(read(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.similar_components(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_order_minhash": op3_order_minhash,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_sharding": op6_sharding,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_simhash": op8_simhash,
    "op9_ngram_lm": op9_ngram_lm,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_filter_audit": op12_filter_audit,
    "op13_ngram_jaccard": op13_ngram_jaccard,
}
