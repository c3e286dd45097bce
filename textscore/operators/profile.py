"""Corpus profiles: counts, distributions, describe tables, entity tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textscore.corpus import Corpus
from textscore.functions.text import BLANK_CHARS, ENTITY_TOKEN, ENTITY_TYPE, split_blanks
from textscore.operators.labels import binarize_label
from textscore.operators.quantiles import exact_quantiles
from textscore.session import pin_small

ALL = "all"
NO_CATEGORY = "\0"
WHOLE = "_whole"


def _all_and_groups(c: Corpus, df: DataFrame, *aggs: Column) -> DataFrame:
    """Aggregates for the whole table and for each category, in one pass."""
    return _flagged(c, df, *aggs).drop(WHOLE)


def _flagged(c: Corpus, df: DataFrame, *aggs: Column) -> DataFrame:
    """The same, with the mark that tells the whole table from a category of its name."""
    return (
        df.rollup(c.cat).agg(*aggs, (F.grouping(c.cat) == 1).alias(WHOLE))
        .withColumn("dataset", F.when(F.col(WHOLE), F.lit(ALL)).otherwise(F.col(c.cat).cast("string")))
        .where(F.col("dataset").isNotNull())
        .drop(c.cat)
    )


def _distinct_pieces(c: Corpus) -> DataFrame:
    """Each word and each kind of blank once per category.

    This is the only shuffle of text. Words come from a split, blanks from a
    search for each kind of blank, which is much faster than a regex for both.
    """
    x = F.col(c.x)
    blanks = F.array_compact(F.array(*[F.when(x.contains(b), F.lit(b)) for b in BLANK_CHARS]))
    items = F.array_distinct(F.concat(split_blanks(x), blanks))
    return (
        c.df.where(x.isNotNull())
        .select(F.coalesce(F.col(c.cat).cast("string"), F.lit(NO_CATEGORY)).alias("dataset"), F.explode(items).alias("item"))
        .distinct()
    )


def _per_group_and_all(pairs: DataFrame, counts: Column, out: str) -> DataFrame:
    """Distinct items that count, per category and overall.

    Both read the same distinct pairs. The category is never NULL there and the
    conditions are written so that the optimizer cannot move one of them below the pairs in
    one branch only: then the text would be split once per branch instead of once.
    """
    groups = (
        pairs.groupBy("dataset").agg(F.count_if(counts).alias(out))
        .where((F.col("dataset") != NO_CATEGORY) | (F.col(out) < 0))
    )
    whole = (
        pairs.groupBy("item").agg(F.count(F.lit(1)).alias("_k"))
        .agg(F.count_if((F.col("_k") > 0) & counts).alias(out))
    )
    groups = groups.withColumn(WHOLE, F.lit(False))
    return groups.unionByName(whole.select(F.lit(ALL).alias("dataset"), out, F.lit(True).alias(WHOLE)))


def unique_words(c: Corpus, approx: bool = False) -> DataFrame:
    """Distinct words per category and overall; empty words count."""
    if approx:
        words = c.df.select(c.cat, F.explode(F.array_distinct(split_blanks(F.col(c.x)))).alias("word"))
        return _all_and_groups(c, words, F.approx_count_distinct("word").alias("unique_words"))
    return _words(c).drop(WHOLE)


def _words(c: Corpus) -> DataFrame:
    return _per_group_and_all(_distinct_pieces(c), ~F.col("item").isin(*BLANK_CHARS), "unique_words")


def unique_chars(c: Corpus) -> DataFrame:
    """Distinct characters per category and overall.

    They come from the distinct words and blanks, so no row per character of
    text is ever made.
    """
    return _chars(c).drop(WHOLE)


def _chars(c: Corpus) -> DataFrame:
    letters = F.explode(F.array_distinct(F.split("item", ""))).alias("item")
    chars = _distinct_pieces(c).select("dataset", letters).distinct()
    return _per_group_and_all(chars, F.col("item") != "", "unique_chars")


def corpus_summary(c: Corpus) -> DataFrame:
    """Rows, unique words, unique characters, mean length and mean score for
    the whole table (``all``) and for each category."""
    measures = c.df.select(
        c.cat, F.coalesce(F.length(c.x), F.lit(0)).alias("_length"), F.col(c.y).cast("double").alias("_score")
    )
    rows = _flagged(
        c, measures,
        F.count(F.lit(1)).alias("n_rows"),
        F.avg("_length").alias("mean_length"),
        F.avg("_score").alias("mean_score"),
    )
    return (
        rows.join(_words(c), [WHOLE, "dataset"], "left")
        .join(_chars(c), [WHOLE, "dataset"], "left")
        .select(
            "dataset", "n_rows",
            F.coalesce("unique_words", F.lit(0)).alias("unique_words"),
            F.coalesce("unique_chars", F.lit(0)).alias("unique_chars"),
            "mean_length", "mean_score",
        )
    )


def score_counts_wide(c: Corpus, values: Sequence = (1, 2, 3, 4, 5)) -> DataFrame:
    """One column per score; a score that does not occur counts 0."""
    return _all_and_groups(
        c, c.df, *[F.count_if(F.col(c.y) == v).alias(f"score_{v}") for v in values]
    )


def score_range_by_group(c: Corpus) -> DataFrame:
    return c.df.where(F.col(c.cat).isNotNull()).groupBy(c.cat).agg(
        F.round(F.avg(F.col(c.y).cast("double")), 8).alias("mean_score"),
        F.min(c.y).alias("min_score"),
        F.max(c.y).alias("max_score"),
    )


def distinct_scores(c: Corpus) -> DataFrame:
    return c.df.select(c.y).where(F.col(c.y).isNotNull()).distinct().orderBy(c.y)


def distinct_scores_by_group(c: Corpus) -> DataFrame:
    """Number of distinct scores and their sorted list per category."""
    return c.df.groupBy(c.cat).agg(F.sort_array(F.collect_set(c.y)).alias("scores")).select(
        c.cat, F.size("scores").alias("n_scores"), "scores"
    )


def score_distribution(c: Corpus) -> DataFrame:
    """Rows per score, for the whole table and for each category."""
    counts = c.df.where(F.col(c.y).isNotNull()).groupBy(c.cat, c.y).agg(F.count(F.lit(1)).alias("n"))
    groups = counts.select(F.col(c.cat).cast("string").alias("dataset"), c.y, "n")
    whole = counts.groupBy(c.y).agg(F.sum("n").alias("n")).select(F.lit(ALL).alias("dataset"), c.y, "n")
    return groups.where(F.col("dataset").isNotNull()).unionByName(whole).orderBy("dataset", c.y)


def score_distribution_binarized(c: Corpus, threshold: float = 4) -> DataFrame:
    return score_distribution(c.with_df(binarize_label(c.df, c.y, threshold)))


def bin_distribution(labelled: DataFrame, by: str = "essay_set", label: str = "domain1_score") -> DataFrame:
    """Rows per class and set, after categorising."""
    return (
        labelled.where(F.col(label).isNotNull())
        .groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(by, label)
    )


def histogram_by_group(df: DataFrame, col: str, by: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between the extremes of each group; the last is closed.

    A group with one value gets the range of one unit around it. A value is
    moved to the neighbour bin if rounding put it on the wrong side of an edge.
    """
    rows = df.where(F.col(col).isNotNull() & F.col(by).isNotNull())
    value = F.col(col).cast("double")
    limits = rows.groupBy(by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    limits = pin_small(limits.select(
        by,
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    ))
    width = (F.col("_hi") - F.col("_lo")) / bins

    def edge(k: Column) -> Column:
        return F.when(k == bins, F.col("_hi")).otherwise(F.col("_lo") + k * width)

    guess = F.least(F.floor((value - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
    moved = (
        F.when(value < edge(F.col("_k")), F.col("_k") - 1)
        .when((value >= edge(F.col("_k") + 1)) & (F.col("_k") < bins - 1), F.col("_k") + 1)
        .otherwise(F.col("_k"))
    )
    return (
        rows.join(limits, by).withColumn("_k", guess)
        .groupBy(by, moved.cast("int").alias("bin"), "_lo", "_hi")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(by, "bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), "n")
    )


DESCRIBE = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")


def describe_by_group(df: DataFrame, by: str, cols: Sequence[str]) -> DataFrame:
    """One row per (group, column): count, mean, std, extremes and quartiles.

    All columns are aggregated in one pass and the short result is turned
    into rows; the quartiles are exact and come from counts of equal values.
    A column without any value in a group has NULL everywhere.
    """
    aggs = []
    for c in cols:
        v = F.col(c).cast("double")
        aggs += [
            F.count(v).alias(f"{c}#n"), F.avg(v).alias(f"{c}#mean"), F.stddev_samp(v).alias(f"{c}#std"),
            F.min(v).alias(f"{c}#min"), F.max(v).alias(f"{c}#max"),
        ]
    wide = df.where(F.col(by).isNotNull()).groupBy(by).agg(*aggs)
    stats = wide.select(by, F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            F.when(F.col(f"{c}#n") > 0, F.col(f"{c}#n")).cast("double").alias("count"),
            *[F.col(f"{c}#{m}").alias(m) for m in ("mean", "std", "min", "max")],
        )
        for c in cols
    ])))
    cells = df.select(by, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_value")) for c in cols
    ])))
    quartiles = exact_quantiles(cells, [by, "column"], "_value", [0.25, 0.5, 0.75])
    return stats.join(quartiles, [by, "column"], "left").select(
        by, "column", "count", "mean", "std", "min",
        *[F.get("q", F.lit(i)).alias(p) for i, p in enumerate(("p25", "p50", "p75"))], "max",
    )


def describe_report(
    df: DataFrame, by: str, cols: Sequence[str], groups: Sequence = tuple(range(1, 9))
) -> DataFrame:
    """Rows (column, metric), one column per group; mean rounded to 2 places."""
    long = describe_by_group(df, by, cols).select(
        by, "column",
        F.inline(F.array(*[
            F.struct(
                F.lit(m).alias("metric"),
                (F.round(F.col(m), 2) if m == "mean" else F.col(m)).alias("value"),
            )
            for m in ("count", "mean", "min", "max")
        ])),
    )
    return long.groupBy("column", "metric").agg(*[
        F.max(F.when(F.col(by) == g, F.col("value"))).alias(f"set_{g}") for g in groups
    ])


# ---------------------------------------------------------------- entities

def _entity_words(df: DataFrame, x: str) -> DataFrame:
    """Words that start with ``@``. Texts without one are dropped before the split."""
    found = F.filter(split_blanks(F.col(x)), lambda w: w.startswith("@"))
    return df.where(F.col(x).contains("@")).select(F.explode(found).alias("word"))


def entity_words(df: DataFrame, x: str) -> DataFrame:
    return _entity_words(df, x).distinct()


def entity_tag_counts(df: DataFrame, x: str) -> DataFrame:
    """Occurrences per tag with its number, for example ``@CAPS1``."""
    tag = F.regexp_extract("word", ENTITY_TOKEN, 0)
    return (
        _entity_words(df, x).select(tag.alias("tag")).where(F.col("tag") != "")
        .groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy("tag")
    )


def entity_tag_types(df: DataFrame, x: str) -> DataFrame:
    kind = F.regexp_extract("word", ENTITY_TYPE, 0)
    return _entity_words(df, x).select(kind.alias("tag_type")).where(F.col("tag_type") != "").distinct()


def token_length_stats(df: DataFrame, ids: str, x: str) -> DataFrame:
    """Token counts, and the count of the longest text (by characters).

    Of equally long texts the one with most tokens is taken.
    """
    n = F.size(ids).cast("bigint")
    return df.agg(
        F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"), F.avg(n).alias("mean_tokens"),
        F.max_by(n, F.struct(F.length(x), n)).alias("tokens_of_longest"),
    )
