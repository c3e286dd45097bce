"""Registered queries of this subpackage, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textscore.llm.byte_bpe import corpus_bpe
from textscore.llm.common import table
from textscore.llm.hard_negatives import hard_negatives
from textscore.llm.licenses import license_scan
from textscore.llm.packing import pack_documents
from textscore.llm.part_codes import part_codes
from textscore.llm.postings import decontaminate
from textscore.llm.quality_model import quality_scores
from textscore.llm.quality_rules import quality_rules
from textscore.llm.queries_sql import BENCHMARK_HITS, HARD_NEGATIVES, NEAR_VECTORS, PART_CODES, QUALITY_RULES, REPEATED_STRINGS
from textscore.llm.simhash import simhash_near_dedup
from textscore.llm.suffixes import suffix_dedup
from textscore.llm.token_counts import token_counts
from textscore.llm.toxicity import toxicity_scores
from textscore.llm.vectors import embedding_near_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def in_sql(sql: str):
    """The SQL that gives the same rows as the query below it."""
    def register(fn):
        ORACLES[fn.__name__] = sql
        return fn

    return register


@query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(table(spark, sf_dir, "documents"), shingle=4, radius=4)


@in_sql(NEAR_VECTORS)
@query
def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(table(spark, sf_dir, "embeddings"), threshold=0.93)


@in_sql(QUALITY_RULES)
@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, added=True)


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return corpus_bpe(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, with_ids=False)


@in_sql(REPEATED_STRINGS)
@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


@in_sql(BENCHMARK_HITS)
@query
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)


@in_sql(PART_CODES)
@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_codes(table(spark, sf_dir, "embeddings"), scale=4096, parts=8, entries=16, rounds=6)


@in_sql(HARD_NEGATIVES)
@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), every=100, scale=256, positives=5, negatives=5)
