"""The corpus pipeline: toxicity, near-dedup, suffix dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshwright.llm import mixing, packing, simhash, suffix, toxicity
from meshwright.llm.common import read_table, write_table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the factorization machine, learnt from the labelled ones, scores as toxic."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return simhash.drop_near_duplicates(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take passages of 100 bytes and more out where an earlier document, or the same one earlier, has them."""
    return suffix.drop_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents to the sources' target weights, in shuffled order."""
    return mixing.mix_sources(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences: one row per piece."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity_filter), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("mixing", mix), ("packing", pack)]

#: SQL can't express the trained filter nor the fitted patterns. tests/llm holds each stage's operator against brute force or held-out accuracy, and the
#: stages' rows and columns.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
