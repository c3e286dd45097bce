"""From raw documents to packed training sequences: quality, toxicity, near-duplicates, repeated passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textscore.llm.common import dropped, table, written
from textscore.llm.packing import pack_documents
from textscore.llm.quality_model import keep_good
from textscore.llm.simhash import one_of_each
from textscore.llm.suffixes import without_repeats
from textscore.llm.toxicity import keep_civil
from textscore.session import drop_scratch, scratch_mark


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    return keep_civil(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return one_of_each(docs, shingle=4, radius=4)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that stand earlier; ``n_chars`` counts what is left."""
    return without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, added=True)


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

#: SQL cannot express fitted models, fingerprints and tokenizers; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; each stage's result is a table in the shared folder.

    What a stage wrote on its way goes when its result is there, and a result when the next one is.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        mark = scratch_mark()
        docs = written(stage(spark, docs, sf_dir), name)
        drop_scratch(spark, mark, docs.scratch_path)
        if last is not None:
            dropped(last)
        last = docs
    return docs
