"""From raw documents to token ids: quality rules, line dedup, near-duplicates, mixing to weights, byte-level BPE.

Each stage works on all that the one before kept. A stage's result is written as Parquet in a folder of its own below
spark.checkpoint.dir, which all executors share, and read again as the next stage's documents; so a lost executor costs
tasks of one stage. All stages but the last return the columns of documents, whatever other columns there are and whatever their
names; n_chars follows the text. The SQL for run() is left out: the edit join of stage two and the shingle sets of stage three can't
be written in it; tests/llm/test_pipeline.py has plain versions.

Defined results: null and empty texts have no words, so the rules reject them. Given to a later stage, they stay in line dedup, are
near-duplicates of each other, take no tokens in mixing and encode to no ids. A null doc_id stands before all others in line dedup and
is never a near-duplicate; rows that repeat a doc_id and its text are kept or dropped alike in the first three stages. An empty table
gives an empty result in every stage. Texts are taken whole, however long they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import byte_bpe, line_dedup, mixing, quality_rules, simhash
from quernstone.llm.common import quoted, read, text_or_empty, words
from quernstone.llm.queries import vocabulary
from quernstone.sources.storage import Scratch


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines go that stand earlier, or one edit away from an earlier one; a document with none left goes."""
    return line_dedup.dedup_lines(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains, languages and sources by their weights; a document is there once for each epoch that takes it."""
    tokens = F.size(words(text_or_empty("text")))
    return mixing.mix(docs, mixing.production_path(), mixing.PRODUCTION_WEIGHTS, tokens).select(*(quoted(c) for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, by digest, with the digest of what they decode to."""
    return byte_bpe.round_trip(docs, *vocabulary())


STAGES = [("quality rules", good), ("line dedup", lines), ("near-duplicates", near), ("mixing", mix), ("byte-level BPE", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.store(docs)
            scratch.keep_last()
    return docs
