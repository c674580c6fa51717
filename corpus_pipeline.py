"""Documents to packed training sequences: toxicity filter, exact and near deduplication, mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trajectra.llm.common import materialise, table
from trajectra.llm.exact_dedup import drop_exact_duplicates
from trajectra.llm.mixing import mix_documents
from trajectra.llm.ngram_join import drop_near_duplicates
from trajectra.llm.packing import pack_documents
from trajectra.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that score as toxic."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the one with the smallest id."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says: not at all, once or more often."""
    return mix_documents(docs, table(spark, sf_dir, "labels"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in sequences."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("ngram_jaccard_join", near_dedup), ("mixing", mixing), ("best_fit_packing", packing)]

#: Compression, a fitted classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order over all documents, each on what the one before wrote. Null texts are empty ones, null and repeated
    ids rows like others, as the stages' operators say; an empty table gives no sequence. Columns are kept up to the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
