"""Cleaning of ``documents`` for training, in stages that each read what the one before has written.

Every stage takes nulls in any column, empty and very long texts, repeated rows and further columns of any
name, and gives no rows for an empty table. A null text counts as an empty one. Stages but the last return the
columns that they got, in their order, whatever their names: working columns get names that are free.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontaminate, pieces, quality, simhash, toxicity
from corvane.llm.common import batches_of, fresh_path, modest_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go. The model is fitted on the stage's input and the labels.

    Rows are judged one by one, so repeated rows stay or go together. Texts without a toxic passage, empty
    ones too, all have one score: about the share of toxic documents among the labelled ones of this kind.
    """
    modest_batches(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, and those of hosts that mostly fail, go.

    Empty texts have fewer than 20 words and go; rows without a source are one host; repeated
    rows stay or go together.
    """
    modest_batches(spark)
    return quality.without_failures(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id.

    Of ties, and of rows that repeat, exactly one stays; a null doc_id comes after all others. Texts
    without words are copies of each other.
    """
    modest_batches(spark)
    return simhash.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go. Empty texts and items hold nothing; repeated rows stay or go together."""
    modest_batches(spark)
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns with ``pieces`` (SentencePiece ids) and ``n_pieces``; the documents' own columns of these two names are replaced.

    One row for each row; empty texts have no pieces.
    """
    modest_batches(spark)
    encoded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.withColumn("n_pieces", F.size("pieces"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("sentencepiece encoding", encode_pieces),
]

#: Model fitting and SimHash are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns, read from what it has written. The session's batch size is afterwards what it was."""
    docs = table(spark, sf_dir, "documents")
    with batches_of(spark):
        for _, stage in STAGES:
            path = fresh_path(spark, "stage")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
