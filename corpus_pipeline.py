"""Corpus pipeline: language, exact and near duplicates, benchmark passages, tokens.

Each stage is one operator of ``epsgrid.llm``; it takes what its predecessor kept and all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epsgrid.llm import bpe, decontaminate, exact_dedup, langid, simhash
from epsgrid.llm.common import pick, prepare, read
from epsgrid.session import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models learned from this input do not reject."""
    return langid.identify(docs, langid.train(docs), keep=COLUMNS[1:]).where(~F.col("rejected")).select(*COLUMNS)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_duplicates(docs, COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of linked fingerprints; documents
    that share an id share the decision, a component without any id stays whole."""
    found = simhash.near_duplicates(docs, shingle=4, radius=4)
    stay = (found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("id"))
            .distinct().checkpoint())
    return pick(docs, *COLUMNS).join(stay, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"), COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("exact_dedup", exact_duplicates), ("simhash", near_duplicates),
          ("decontaminate", benchmark_passages), ("bpe", tokens)]

#: The language models and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
