"""Cleaning of a document corpus: every stage works on all rows that the one before it kept.

Each stage gets the documents of the one before as written Parquet and returns a DataFrame: all
but the last with the columns of documents. Rows with a null text pass the filters; rows without a doc_id
are judged by their text like any other. What a stage wrote goes as soon as the next one is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lumisift.llm import bpe, decontam, jaccard, secrets, toxicity
from lumisift.llm.common import remove, shared_folder, table


def toxicity_chain(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest doc_id."""
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets of any layer replaced by marks, n_chars counted anew."""
    return secrets.redacted(docs)


def bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, offsets and digests of all documents."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", toxicity_chain),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE encoding and decoding", bpe_ids),
]

#: No SQL expresses a trained classifier, alignment or byte-level BPE; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = shared_folder(spark, f"pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex[:6]}")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(out)
        docs = spark.read.schema(made.schema).parquet(out)
        if last:
            remove(spark, last)
        last = out
    return docs
