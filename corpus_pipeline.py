"""From raw documents to packed training sequences: five stages, each on what the last one kept.

``STAGES`` lists them; every stage takes (spark, docs, sf_dir) and returns a
DataFrame, written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh, read, settled, vocabulary_file
from ledgerloom.llm.exact_dedup import keep_distinct
from ledgerloom.llm.labelled import fold, training_rows
from ledgerloom.llm.ngram_join import keep_one
from ledgerloom.llm.packing import pack
from ledgerloom.llm.pii import mask_pii
from ledgerloom.llm.toxicity import fit, with_score

TOXIC = 0.3  # documents that score this or more go
ORACLE_SQL = None  # the first stage is a fitted model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose deobfuscated text scores as toxic go."""
    train = training_rows(docs, read(spark, sf_dir, "labels"), "toxic", fold(F.col("doc_id"), 4) != 2,
                          "doc_id", "text")
    score = fresh("toxic_score", docs.columns)
    return with_score(docs, fit(docs, train, "text"), "text", score).where(F.col(score) < TOXIC).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the largest id."""
    return keep_distinct(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays, the one with the smallest id."""
    return keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; ``n_chars`` follows."""
    masked = mask_pii(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.length("text").cast(kind))
    return masked


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised pieces with their place in sequences of 1024."""
    return pack(docs, vocabulary_file("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_jaccard_join", drop_near_copies),
          ("pii", mask_personal_data), ("best_fit_packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
