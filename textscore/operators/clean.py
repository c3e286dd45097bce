"""Cleaning, projections, filters and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textscore.corpus import Corpus
from textscore.functions.text import ENTITY_TAGS, separate_tags
from textscore.operators.selection import column_order, positions

# Cells that stand for a missing value.
NULL_TOKENS = ("", "<NA>")
DIGITS = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def null_tokens(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Whole cells equal to a null token become NULL, in every text column."""
    fixed = [
        F.when(~F.col(f.name).isin(*tokens), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*fixed)


def to_whole_number(col: Column) -> Column:
    """Number in text to BIGINT; NULL if it cannot be read or has a fraction.

    Digits alone are read as they are, however many; only other forms go through a floating number.
    """
    text = F.trim(col.cast("string"))
    value = F.when(text.rlike(NUMBER), text).try_cast("double")
    return F.coalesce(F.when(text.rlike(DIGITS), text).try_cast("bigint"), F.when(value == F.floor(value), value.try_cast("bigint")))


def coerce_numeric(df: DataFrame, except_: Sequence[str] = ("essay",)) -> DataFrame:
    """Every column but the named ones becomes a nullable BIGINT."""
    return df.select(*[
        F.col(c) if c in except_ else to_whole_number(F.col(c)).alias(c) for c in df.columns
    ])


def count_nonintegral(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """How many cells per column are numbers with a fraction (they become NULL)."""
    def fractional(c: str) -> Column:
        text = F.trim(F.col(c).cast("string"))
        value = F.when(text.rlike(NUMBER), text).try_cast("double")
        return F.count_if(value != F.floor(value)).alias(c)

    return df.agg(*[fractional(c) for c in cols])


def drop_incomplete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def row_id(df: DataFrame, order_by: str, name: str = "row_id") -> DataFrame:
    """Contiguous index 0..n-1 in the order of a unique numeric key."""
    return positions(df, column_order(df, order_by), name=name)


def split_entity_tags(df: DataFrame, col: str, tags: Sequence[str] = ENTITY_TAGS) -> DataFrame:
    return df.withColumn(col, separate_tags(F.col(col), tags))


def union_sources(*dfs: DataFrame) -> DataFrame:
    """Rows of all frames; columns a frame lacks are NULL there."""
    result = dfs[0]
    for other in dfs[1:]:
        result = result.unionByName(other, allowMissingColumns=True)
    return result


def replace_column_keep_rest(df: DataFrame, col: str, value: Column) -> DataFrame:
    """Swap one column for a new value of the same row and put it last."""
    return df.select(*[c for c in df.columns if c != col], value.alias(col))


def string_guard(df: DataFrame, x: str, by: str) -> DataFrame:
    """Rows in all, rows with text and characters of text per group.

    Rows without text count as rows but add no length.
    """
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(x).alias("n_texts"),
        F.coalesce(F.sum(F.length(x)), F.lit(0)).cast("bigint").alias("n_chars"),
    )


def unique_labels(c: Corpus) -> DataFrame:
    return c.df.select(c.y).where(F.col(c.y).isNotNull()).distinct()


def unique_categories(c: Corpus, with_all: bool = False) -> DataFrame:
    found = c.df.select(F.col(c.cat).cast("string").alias(c.cat)).where(F.col(c.cat).isNotNull()).distinct()
    if not with_all:
        return found
    every = c.df.sparkSession.createDataFrame([("All",)], found.schema)
    return every.unionByName(found)


def num_classes(c: Corpus) -> DataFrame:
    """Count of distinct labels; NULL is no class."""
    return c.df.agg(F.count_distinct(c.y).alias("num_classes"))


def head_rows(df: DataFrame, id: str, n: int = 5) -> DataFrame:
    return df.orderBy(id).limit(n)


def preprocess_essays(df: DataFrame, keep: Sequence[str] = (), plan=None) -> DataFrame:
    """Raw essay table to labelled essays: clean, separate tags, bin scores. Columns ``keep`` stay as they are."""
    from textscore.operators.labels import ESSAY_PLAN, categorize_by_set

    cleaned = clean_essays(df, keep)
    return categorize_by_set(cleaned, ESSAY_PLAN if plan is None else plan)


def clean_essays(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The part of the preparation that looks at one row at a time."""
    return (
        df.transform(null_tokens)
        .transform(coerce_numeric, ("essay", *keep))
        .transform(drop_incomplete, ["essay", "domain1_score"])
        .transform(split_entity_tags, "essay")
    )
