"""Scores to class labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textscore.operators.quantiles import exact_quantiles
from textscore.session import pin_small

# How each essay set turns its score into a class 1..4.
ESSAY_PLAN = {
    1: ("edges", (1, 7, 8, 9, 12)),
    2: ("edges", (0, 2, 3, 4, 6)),
    3: ("shift", 1),
    4: ("shift", 1),
    5: ("edges", (-1, 1, 2, 3, 4)),
    6: ("edges", (-1, 1, 2, 3, 4)),
    7: ("quantiles", 4),
    8: ("quantiles", 4),
}


def bin_edges(value: Column, edges: Sequence, lowest: bool = False) -> Column:
    """Class of the interval ``(a, b]`` that holds the value, from 1; else NULL.

    ``edges`` may be numbers or columns. ``lowest`` closes the first interval
    on the left as well.
    """
    edges = [e if isinstance(e, Column) else F.lit(e) for e in edges]
    first_hit = F.lit(None).cast("int")
    for k in range(len(edges) - 1, 0, -1):
        left = value >= edges[0] if lowest and k == 1 else value > edges[k - 1]
        first_hit = F.when(left & (value <= edges[k]), F.lit(k)).otherwise(first_hit)
    return first_hit


def bin_fixed_edges(df: DataFrame, col: str, edges: Sequence, out: str = "label") -> DataFrame:
    return df.withColumn(out, bin_edges(F.col(col), edges))


def shift_label(df: DataFrame, col: str, by: int = 1, out: str = "label") -> DataFrame:
    return df.withColumn(out, F.col(col) + by)


def quantile_edges(df: DataFrame, col: str, q: int, by: str, exact: bool = True) -> DataFrame:
    """One row per group with the ``q + 1`` edges as an array.

    ``exact=False`` gives the approximate sketch in one pass.
    """
    probs = [i / q for i in range(q + 1)]
    if exact:
        return exact_quantiles(df, [by], col, probs, "edges")
    sketch = F.percentile_approx(F.col(col), probs, 100_000).cast("array<double>")
    rows = df.where(F.col(col).isNotNull() & F.col(by).isNotNull())
    return rows.groupBy(by).agg(sketch.alias("edges"))


def _checked_edges(df: DataFrame, col: str, q: int, by: str, exact: bool) -> DataFrame:
    edges = pin_small(quantile_edges(df, col, q, by, exact))
    twins = edges.where(F.size(F.array_distinct("edges")) < q + 1).select(by).limit(1).collect()
    if twins:
        raise ValueError(f"bin edges must be unique: group {by}={twins[0][0]} has equal quantiles")
    return edges


def bin_quantiles(
    df: DataFrame, col: str, q: int = 4, by: str | None = None, exact: bool = True, out: str = "label"
) -> DataFrame:
    """Class 1..q by the quantiles of the group, lowest value included."""
    columns = df.columns
    if by is None:
        by, df = "_all", df.withColumn("_all", F.lit(0))
    edges = _checked_edges(df, col, q, by, exact)
    label = bin_edges(F.col(col), [F.get("edges", F.lit(i)) for i in range(q + 1)], lowest=True)
    return df.join(edges, by, "left").select(*[c for c in columns if c != out], label.alias(out))


def categorize_by_set(
    df: DataFrame, plan: dict = ESSAY_PLAN, col: str = "domain1_score", by: str = "essay_set"
) -> DataFrame:
    """Replace the score by its class, with the rule of the row's own set.

    One CASE over the set: no split into frames, no union. Only the quantile
    sets need a look at the data first, and their few edges are broadcast.
    """
    score = F.col(col)
    quantile_sets = [k for k, (kind, _) in plan.items() if kind == "quantiles"]
    columns = df.columns
    if quantile_sets:
        q = plan[quantile_sets[0]][1]
        edges = _checked_edges(df.where(F.col(by).isin(quantile_sets)), col, q, by, True)
        df = df.join(edges, by, "left")
        by_quantile = bin_edges(score, [F.get("edges", F.lit(i)) for i in range(q + 1)], lowest=True)
    rule = F.lit(None).cast("bigint")
    for key, (kind, arg) in plan.items():
        if kind == "edges":
            label = bin_edges(score, arg)
        elif kind == "shift":
            label = score + arg
        else:
            label = by_quantile
        rule = F.when(F.col(by) == key, label.cast("bigint")).otherwise(rule)
    return df.select(*[c for c in columns if c != col], rule.alias(col))


def binarize_label(df: DataFrame, col: str, threshold: float = 4, out: str | None = None) -> DataFrame:
    """1 above the threshold, else 0, also where there is no score."""
    return df.withColumn(out or col, F.coalesce(F.col(col) > threshold, F.lit(False)).cast("int"))


def standardize_by_group(
    df: DataFrame, col: str, by: str, binarize: float | None = None, out: str = "score_std"
) -> DataFrame:
    """Scale to [-1, 1] by the least and greatest score of the group.

    A group with a single score value has no range and gives NULL; rows without a group are a group of their own. With
    ``binarize`` the scaled score becomes 1 above that threshold, else 0, also where there is no range or no score.
    """
    columns = df.columns
    limits = pin_small(df.groupBy(F.col(by).alias("_of")).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi")))
    span = (F.col("_hi") - F.col("_lo")).cast("double")
    scaled = 2 * F.try_divide((F.col(col) - F.col("_lo")).cast("double"), span) - 1
    if binarize is not None:
        scaled = F.coalesce(scaled > binarize, F.lit(False)).cast("int")
    # A struct is never null, so the null group is joined like the others, by a hash join.
    return df.join(limits, F.struct(df[by]) == F.struct(limits["_of"])).select(*[df[c] for c in columns if c != out], scaled.alias(out))


def standardize_binarize(df: DataFrame, col: str, by: str, threshold: float = 0.0, out: str = "label") -> DataFrame:
    return standardize_by_group(df, col, by, binarize=threshold, out=out)


def class_index(df: DataFrame, col: str, score_type: str = "categorical", out: str = "y") -> DataFrame:
    """Label as a model target: 0-based class, 0/1 as it is, or a float."""
    targets = {
        "categorical": lambda: (F.col(col) - 1).cast("int"),
        "binary": lambda: F.col(col).cast("int"),
        "standardized": lambda: F.col(col).cast("float"),
    }
    if score_type not in targets:
        raise ValueError(f"unknown score type: {score_type}")
    return df.withColumn(out, targets[score_type]())


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """One over the share of each class: total rows / rows of the class."""
    counts = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select(y, "n", (total / F.col("n")).alias("weight"))




def label_reviews(df: DataFrame, col: str = "overall", score_type: str = "categorical", threshold: float = 4) -> DataFrame:
    """Review scores as they are, or 1 above the threshold and 0 up to it."""
    if score_type == "categorical":
        return df
    if score_type == "binary":
        return binarize_label(df, col, threshold)
    raise NotImplementedError(f"review scores have no {score_type} form")


def label_essays(
    df: DataFrame, col: str = "domain1_score", by: str = "essay_set", score_type: str = "categorical",
    threshold: float = 0.0,
) -> DataFrame:
    """Essay scores as classes 1..4, scaled to [-1, 1], or 1 above a scaled threshold."""
    if score_type == "categorical":
        return categorize_by_set(df, col=col, by=by)
    if score_type == "standardized":
        return standardize_by_group(df, col, by, out=col)
    if score_type == "binary":
        return standardize_by_group(df, col, by, binarize=threshold, out=col)
    raise ValueError(f"unknown score type: {score_type}")
