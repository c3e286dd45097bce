"""Profiles of corpora that grow: sketches per category and file are kept in a table, and new files only add to it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textscore.corpus import Corpus
from textscore.functions.text import BLANK_CHARS, split_blanks
from textscore.operators.profile import ALL
from textscore.session import path_exists

#: Registers of a distinct count are 2 to this power; the standard error is ``1.04 / sqrt(registers)``.
PRECISION = 15
#: Size of a quantile sketch.
RANKS = 1024
SKETCHES = "file string, category string, n_rows bigint, length bigint, score double, n_scores bigint, words binary, chars binary, ranks binary"


def rank_error(ranks: int = RANKS) -> float:
    """The share of rows by which a quantile may lie off, with a probability of 99 %, as published for this sketch."""
    return 2.296 / ranks ** 0.9021


def sketch_files(c: Corpus, file: str, precision: int = PRECISION, ranks: int = RANKS) -> DataFrame:
    """A row for each file and category: counts and sums, sketches of distinct words and characters and of the scores.

    Texts are read once and not shuffled, as every task makes sketches of what it reads. Rows without text count
    with length 0 and without score in no mean. A category may be null.
    """
    x, y = F.col(c.x), F.col(c.y).cast("double")
    empty = F.array().cast("array<string>")

    def items(kind: str, found: Column) -> Column:
        return F.transform(F.coalesce(found, empty), lambda i: F.struct(
            F.lit(kind).alias("kind"), F.xxhash64(i).alias("item"), F.lit(None).cast("bigint").alias("length"), F.lit(None).cast("double").alias("score")))

    row = F.struct(F.lit("row").alias("kind"), F.lit(None).cast("bigint").alias("item"),
                   F.coalesce(F.length(x), F.lit(0)).cast("bigint").alias("length"), y.alias("score"))
    blanks = F.array_compact(F.array(*[F.when(x.contains(b), F.lit(b)) for b in BLANK_CHARS]))
    words = F.array_distinct(split_blanks(x))
    letters = F.array_distinct(F.concat(F.split(F.array_join(words, ""), ""), blanks))
    letters = F.filter(letters, lambda ch: ch != "")
    parts = F.concat(F.array(row), items("word", words), items("char", letters))
    rows = c.df.select(F.col(file).alias("file"), F.col(c.cat).cast("string").alias("category"), F.explode(parts).alias("p")).select("file", "category", "p.*")

    def of(kind: str, value: str) -> Column:
        return F.when(F.col("kind") == kind, F.col(value))

    return rows.groupBy("file", "category").agg(
        F.count_if(F.col("kind") == "row").alias("n_rows"), F.sum("length").alias("length"),
        F.sum("score").alias("score"), F.count("score").alias("n_scores"),
        F.hll_sketch_agg(of("word", "item"), precision).alias("words"), F.hll_sketch_agg(of("char", "item"), precision).alias("chars"),
        F.kll_sketch_agg_double("score", ranks).alias("ranks"))


def read_sketches(spark: SparkSession, folder: str) -> DataFrame:
    there = path_exists(spark, folder)
    return spark.read.schema(SKETCHES).parquet(folder) if there else spark.createDataFrame([], SKETCHES)


def add_files(spark: SparkSession, paths: Sequence[str], read: Callable[[list[str]], Corpus], folder: str,
              file: str = "file", precision: int = PRECISION, ranks: int = RANKS) -> list[str]:
    """Add the sketches of those files that the table in ``folder`` does not hold yet, and return their paths.

    ``read`` gets the new paths only and returns a corpus with the path of each row, as listed, in column ``file``. A file is known by its
    path: one that changes under the same path is not read again. A file without rows adds nothing and is
    read again. One call at a time may write to a folder; one that fails leaves no rows.
    """
    given = spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "file string")
    new = [r.file for r in given.join(read_sketches(spark, folder).select("file").distinct(), "file", "left_anti").collect()]
    if new:
        sketch_files(read(sorted(new)), file, precision, ranks).write.mode("append").parquet(folder)
    return sorted(new)


def _merged(sketches: DataFrame) -> DataFrame:
    """Sketches of the whole corpus and of each category; rows of a null category are part of the whole only."""
    merged = sketches.rollup("category").agg(
        *[F.sum(c).alias(c) for c in ("n_rows", "length", "score", "n_scores")],
        F.hll_union_agg("words").alias("words"), F.hll_union_agg("chars").alias("chars"),
        F.kll_merge_agg_double(F.when(F.col("n_scores") > 0, F.col("ranks"))).alias("ranks"), (F.grouping("category") == 1).alias("whole"))
    return merged.withColumn("dataset", F.when(F.col("whole"), F.lit(ALL)).otherwise(F.col("category"))).where("dataset IS NOT NULL")


def growing_summary(sketches: DataFrame) -> DataFrame:
    """The corpus summary from sketches alone. Rows and means are exact; distinct counts have a standard error of
    ``1.04 / sqrt(2 ** PRECISION)``, some 0.6 %. An empty table gives no row or one of nothing."""
    return _merged(sketches).where(F.col("n_rows") > 0).select(
        "dataset", "n_rows", F.hll_sketch_estimate("words").alias("unique_words"), F.hll_sketch_estimate("chars").alias("unique_chars"),
        (F.col("length") / F.col("n_rows")).alias("mean_length"), F.try_divide("score", "n_scores").alias("mean_score"))


def growing_quantiles(sketches: DataFrame, probs: Sequence[float], ranks: int = RANKS) -> DataFrame:
    """Quantiles of the scores of the whole corpus and of each category, each between those that lie a rank error below and above it.

    ``low`` and ``high`` hold the exact quantile with a probability of 99 %. Groups without scores have no rows.
    """
    error = rank_error(ranks)

    def at(place: float) -> Column:
        return F.kll_sketch_get_quantile_double("ranks", F.lit(min(1.0, max(0.0, place))))

    each = [F.struct(F.lit(float(p)).alias("prob"), at(p).alias("value"), at(p - error).alias("low"), at(p + error).alias("high")) for p in probs]
    rows = _merged(sketches).where("n_scores > 0").select("dataset", "n_scores", F.explode(F.array(*each)).alias("q"))
    return rows.select("dataset", "q.prob", "n_scores", "q.value", "q.low", "q.high", F.lit(error).alias("rank_error"))
