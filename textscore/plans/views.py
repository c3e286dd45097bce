"""Derived views over the driver tables, as DataFrames.

Each has a twin of the same content in ``views_sql``. All of them read whole
tables; random values come from a hash of the row key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textscore.corpus import Corpus, essays_corpus, reviews_corpus
from textscore.functions.hashing import hash_int
from textscore.operators.selection import column_order, positions
from textscore.operators.tokens import hashed_ids, word_lists
from textscore.session import made_once, spread_small, via_table

REVIEW_CLASSES = 5
ESSAY_CLASSES = 4
BATCH = 16
DIM = 64

# Lowest score and number of scores of each essay set.
SCORE_RANGES = {1: (2, 11), 2: (1, 6), 3: (0, 4), 4: (0, 4), 5: (0, 5), 6: (0, 5), 7: (2, 23), 8: (10, 51)}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def stamp(spark: SparkSession, d: str, name: str) -> tuple:
    """Folder, files and times of a table: another stamp means other content."""
    files = table(spark, d, name).select("_metadata.file_path", "_metadata.file_modification_time").distinct()
    return d, *files.agg(F.count("file_path"), F.max("file_modification_time")).first()


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread_small(table(spark, d, "documents"), "doc_id")


def _doc_hash(seed: str) -> Column:
    return hash_int(F.col("doc_id"), seed)


def reviews(spark: SparkSession, d: str) -> DataFrame:
    k = _doc_hash("overall") % 23
    overall = F.when(k < 1, 1).when(k < 3, 2).when(k < 6, 3).when(k < 11, 4).otherwise(5)
    return documents(spark, d).select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("reviewText"), F.col("source").alias("type"),
        overall.alias("overall"),
    )


def review_corpus(spark: SparkSession, d: str) -> Corpus:
    return reviews_corpus(reviews(spark, d))


def essays_raw(spark: SparkSession, d: str) -> DataFrame:
    """Essays as they come from a file: every column is text."""
    doc = F.col("doc_id")
    essay_set = F.lit(1) + doc % 8
    score = F.lit(None).cast("bigint")
    for number, (low, n) in SCORE_RANGES.items():
        score = F.when(essay_set == number, low + _doc_hash("score") % n).otherwise(score)
    first = (
        F.when(doc % 37 == 0, "").when(doc % 41 == 0, "<NA>").when(doc % 43 == 0, "x1")
        .otherwise(score.cast("string"))
    )
    second = (
        F.when(essay_set == 2, (1 + _doc_hash("score2") % 4).cast("string")).when(doc % 53 == 0, "9007199254740993")
        .when(doc % 59 == 0, "3d").when(doc % 61 == 0, "4.0").otherwise("")
    )
    return documents(spark, d).select(
        doc.cast("string").alias("essay_id"), essay_set.cast("string").alias("essay_set"),
        F.concat(F.lit("@CAPS"), 1 + doc % 3, F.lit(" "), F.col("text"), F.lit(" @DRIVER")).alias("essay"),
        first.alias("domain1_score"), second.alias("domain2_score"),
    )


def essays_clean(spark: SparkSession, d: str) -> DataFrame:
    from textscore.operators.clean import clean_essays

    return clean_essays(essays_raw(spark, d))


def essays(spark: SparkSession, d: str) -> DataFrame:
    from textscore.operators.clean import preprocess_essays

    return preprocess_essays(essays_raw(spark, d))


def essay_corpus(spark: SparkSession, d: str) -> Corpus:
    return essays_corpus(essays(spark, d))


def predictions(spark: SparkSession, d: str, lowest: int = 0) -> DataFrame:
    """True and predicted class per review; ``lowest=1`` never predicts class 0."""
    rows = reviews(spark, d).withColumn("y_true", F.col("overall") - 1)
    off = hash_int(F.col("row_id"), "err") % 3 - 1
    guess = F.greatest(F.lit(lowest), F.least(F.lit(4), F.col("y_true") + off)).cast("int")
    placed = positions(rows.select("row_id", "type", "y_true", guess.alias("y_pred")), column_order(rows, "row_id"))
    return placed.withColumn("batch_id", F.floor(F.col("pos") / BATCH).cast("bigint"))


def logits(spark: SparkSession, d: str, k: int = REVIEW_CLASSES) -> DataFrame:
    z = F.array(*[(hash_int(F.col("row_id"), j) % 2001 - 1000) / F.lit(250.0) for j in range(k)])
    return predictions(spark, d).select("row_id", "y_true", "batch_id", z.alias("z"))


def token_docs(spark: SparkSession, d: str) -> DataFrame:
    """One row per document with its words and a hashed id per word, up to the number of vectors.

    Tokens are made once and kept as a table, as an encoded corpus would be.
    """
    def build() -> DataFrame:
        words = word_lists(documents(spark, d).select("doc_id", "text"), "text")
        n = table(spark, d, "embeddings").count()
        return via_table(hashed_ids(words, "words", n).select("doc_id", "words", "ids"), "tokens")

    return made_once(spark, ("token_docs", stamp(spark, d, "documents"), stamp(spark, d, "embeddings")), build)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("token_id"), F.col("embedding").alias("v"))


def vocabulary_vectors(spark: SparkSession, d: str, size: int) -> DataFrame:
    """A vector for each id of a vocabulary: the vectors there are, in turn."""
    n = table(spark, d, "embeddings").count()
    ids = spark.range(size).select(F.col("id").cast("int").alias("id"), (F.col("id") % n).cast("int").alias("token_id"))
    return ids.join(vectors(spark, d), "token_id").select(F.col("id").alias("token_id"), "v")


def class_weight(spark: SparkSession, d: str, k: int = REVIEW_CLASSES) -> DataFrame:
    return table(spark, d, "embeddings").where(F.col("vec_id") < k).select(
        F.col("vec_id").cast("int").alias("class"), F.col("embedding").alias("w"), (0.01 * F.col("vec_id")).alias("b")
    )


def runs(spark: SparkSession, d: str) -> DataFrame:
    """A metric per run and epoch: accuracy by language and source, in steps of 5."""
    langs = documents(spark, d).select(F.col("doc_id").alias("row_id"), "lang")
    epoch = F.substring("type", 4, 9).cast("int")
    hits = F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))
    return (
        predictions(spark, d).join(langs, "row_id")
        .groupBy(F.col("lang").alias("run"), epoch.alias("epoch"))
        .agg((F.floor(20 * hits) * 5).cast("double").alias("accuracy"))
    )
