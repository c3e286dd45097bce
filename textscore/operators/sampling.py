"""Filters, seeded samples, class balancing and splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textscore.corpus import Corpus
from textscore.functions.hashing import HASH_RANGE_BITS, hash_int
from textscore.operators.selection import (
    column_order, group_sizes, hash_order, keep_first, positions, split_at,
)
from textscore.session import parallelism, pin_small

DRAW_BLOCK = 65_536
DRAWS_PER_COPY = 1_000

# Length presets in characters.
LENGTH_PRESETS = {"short": (0, 1000), "long": (1000, 6000), "custom": (0, 10000)}


# ---------------------------------------------------------------- filters

def filter_category(c: Corpus, category) -> DataFrame:
    """Rows of one category. An empty or zero category filters nothing."""
    return c.df.where(F.col(c.cat) == category) if category else c.df


def filter_max_length(c: Corpus, length: int | None) -> DataFrame:
    """Texts of at most ``length`` characters. Zero filters nothing."""
    return c.df.where(F.length(c.x) <= length) if length else c.df


def filter_length_range(c: Corpus, low: int, high: int) -> DataFrame:
    if low > high:
        raise ValueError(f"lower length bound {low} is above the upper bound {high}")
    return c.df.where(F.length(c.x).between(low, high))


def filter_score_eq(c: Corpus, score: int) -> DataFrame:
    return c.df.where(F.col(c.y) == score)


def filter_score_range(c: Corpus, low: float, high: float) -> DataFrame:
    return c.df.where(F.col(c.y).between(low, high))


def filter_columns(df: DataFrame, columns: Mapping | None) -> DataFrame:
    """Rows where each named column has the given value or one of the list."""
    for name, value in (columns or {}).items():
        df = df.where(F.col(name).isin(value) if isinstance(value, list) else F.col(name) == value)
    return df


def filter_rows(c: Corpus, category=None, length=None, score=None, columns=None, standardized=False) -> DataFrame:
    """All filters of ``filter_load`` without the sample."""
    c = c.with_df(filter_category(c, category))
    if isinstance(length, bool) or not isinstance(length, (int, list, tuple, type(None))):
        raise TypeError(f"length must be an int or a pair, not {type(length)}")
    if isinstance(length, int):
        c = c.with_df(filter_max_length(c, length))
    elif length:
        c = c.with_df(filter_length_range(c, *length))
    if score is not None:
        if isinstance(score, int) and not isinstance(score, bool):
            if standardized:
                raise TypeError("a standardized score needs a pair of bounds")
            c = c.with_df(filter_score_eq(c, score))
        elif isinstance(score, (list, tuple)):
            c = c.with_df(filter_score_range(c, *score))
        else:
            raise TypeError(f"score must be an int or a pair, not {type(score)}")
    return filter_columns(c.df, columns)


def filter_load(
    c: Corpus, category=None, length=None, score=None, columns=None, n: int = 1,
    fmt: str = "raw", seed: int = 0, standardized: bool = False, encoder=None,
) -> DataFrame:
    """``n`` random rows that pass all filters.

    ``fmt`` is ``index`` (key only), ``raw`` (key, text, label), ``encoding``
    (``raw`` with tokens and offsets) or ``train`` (ids and 0-based label). The last
    two need ``encoder``, a function from a frame to the encoded frame.
    Fewer rows than ``n`` raise.
    """
    if fmt not in ("index", "raw", "encoding", "train"):
        raise NotImplementedError(f"unsupported format: {fmt}")
    kept = filter_rows(c, category, length, score, columns, standardized)
    if kept.agg(F.count(F.lit(1))).first()[0] < n:
        raise ValueError(f"fewer than {n} rows pass the filters")
    picked = sample_n(kept, n, c.id, seed)
    if fmt == "index":
        return picked.select(c.id)
    raw = picked.select(c.id, c.x, c.y)
    if fmt == "raw":
        return raw
    if encoder is None:
        raise ValueError(f"format {fmt} needs an encoder")
    encoded = encoder(raw)
    if fmt == "encoding":
        return encoded
    target = F.col(c.y).cast("float") if standardized else (F.col(c.y) - 1).cast("int")
    return encoded.select(c.id, "ids", target.alias("y"))


# ---------------------------------------------------------------- samples

def sample_n(df: DataFrame, n: int, id: str, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement.

    A cut-off, not a sorted limit: the latter would bring ``n`` whole rows of
    every task to one place.
    """
    return keep_first(df, [], hash_order(df, id, seed), n)


def sample_per_group(
    df: DataFrame, by: str, n: int, id: str, seed: int = 0, exclude: Sequence = ()
) -> DataFrame:
    """``n`` random rows of each group, leaving out the excluded groups."""
    kept = df.where(F.col(by).isNotNull())
    if exclude:
        kept = kept.where(~F.col(by).isin(*exclude))
    return keep_first(kept, [by], hash_order(kept, id, seed), n)


def reduce_per_category(df: DataFrame, n: int, cat: str, order: str) -> DataFrame:
    """The first ``n`` rows of each category in the order of a numeric key."""
    kept = df.where(F.col(cat).isNotNull())
    return keep_first(kept, [cat], column_order(kept, order), n)


def undersample(df: DataFrame, y: str, id: str, seed: int = 0) -> DataFrame:
    """Every class cut to the size of the smallest, without replacement."""
    kept = df.where(F.col(y).isNotNull())
    smallest = group_sizes(kept, y).agg(F.min("_total")).first()[0] or 0
    return keep_first(kept, [y], hash_order(kept, id, seed), int(smallest))


def oversample(df: DataFrame, y: str, id: str, seed: int = 0) -> DataFrame:
    """Every class drawn with replacement to the size of the largest.

    The largest class is drawn as well, so it too loses some of its rows and
    repeats others. Column ``draw`` numbers the draws of a class from 0.

    The draws are made in blocks spread over the cluster. Keys alone are ranked
    and drawn; the rows themselves move once, to meet the picked keys. A row
    of a rare class is drawn very often, so such rows are copied under a salt
    and the draws are dealt over the copies.
    """
    kept = df.where(F.col(y).isNotNull())
    sizes = group_sizes(kept, y)
    largest = int(sizes.agg(F.max("_total")).first()[0] or 0)
    copies = F.ceil(F.lit(largest) / (F.col("_total") * DRAWS_PER_COPY)).cast("bigint")
    sizes = pin_small(sizes.withColumn("_copies", copies))
    blocks = max(1, -(-largest // DRAW_BLOCK))
    starts = F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))
    first = F.col("_block") * DRAW_BLOCK
    last = F.least(first + DRAW_BLOCK, F.lit(largest).cast("bigint")) - 1
    block_rows = sizes.select("*", F.explode(starts).alias("_block"))
    if blocks > 1:
        block_rows = block_rows.repartition(parallelism(df.sparkSession), y, "_block")
    drawn = F.concat_ws("-", F.col(y).cast("string"), F.col("draw").cast("string"))
    draws = (
        block_rows.select(y, "_total", "_copies", F.explode(F.sequence(first, last)).alias("draw"))
        .where(F.lit(largest) > 0)
        .select(
            y, "draw", (hash_int(drawn, seed) % F.col("_total")).alias("_pos"),
            (F.col("draw") % F.col("_copies")).alias("_salt"),
        )
    )

    def salted(rows: DataFrame) -> DataFrame:
        salts = F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1)
        return rows.join(sizes, y).withColumn("_salt", F.explode(salts)).drop("_total", "_copies")

    ranked = positions(kept.select(y, id), hash_order(kept, id, seed), [y], "_pos")
    picks = draws.join(salted(ranked), [y, "_pos", "_salt"]).select(id, "_salt", "draw")
    return salted(kept).join(picks, [id, "_salt"]).select(*df.columns, "draw")


# ---------------------------------------------------------------- splits

def _sizes(fractions: Sequence[float]) -> list[Column]:
    """Cumulative part sizes: floor of each share, the rest to the first parts."""
    total = F.col("_total")
    exact = sum(Fraction(str(f)) for f in fractions)
    if exact != 1:
        raise ValueError("fractions must add up to 1")
    floors = [F.floor(total * F.lit(float(f))).cast("bigint") for f in fractions]
    left = total - sum(floors[1:], floors[0])
    sizes = [f + (F.lit(i) < left).cast("bigint") for i, f in enumerate(floors)]
    ends, so_far = [], None
    for s in sizes[:-1]:
        so_far = s if so_far is None else so_far + s
        ends.append(so_far)
    return ends


def split_exact(df: DataFrame, fractions: Sequence[float], id: str, seed: int = 0) -> DataFrame:
    """Random disjoint parts of exact sizes, numbered in column ``part``."""
    return split_at(df, [], hash_order(df, id, seed), _sizes(fractions))


def split_hash(df: DataFrame, fractions: Sequence[float], id: str, seed: int = 0) -> DataFrame:
    """Random disjoint parts of nearly the given shares, in one pass."""
    value = hash_int(F.col(id), seed)
    part, share = F.lit(0), 0.0
    for f in list(fractions)[:-1]:
        share += f
        part = part + (value >= int(share * 2**HASH_RANGE_BITS)).cast("int")
    return df.withColumn("part", part)


def random_split(df: DataFrame, id: str, validation: float = 0.2, seed: int = 0, exact: bool = False):
    """Training and validation frames."""
    fractions = [float(1 - Fraction(str(validation))), validation]
    split = split_exact if exact else split_hash
    parts = split(df, fractions, id, seed)
    return tuple(parts.where(F.col("part") == p).drop("part") for p in (0, 1))


def balanced_train_input(
    df: DataFrame, y: str, id: str, validation: float = 0.2, seed: int = 0,
    under: bool = False, over: bool = False, exact: bool = True,
):
    """Split first, then balance the training part only."""
    if under and over:
        raise ValueError("choose undersampling or oversampling, not both")
    train, valid = random_split(df, id, validation, seed, exact)
    if under:
        train = undersample(train, y, id, seed)
    elif over:
        train = oversample(train, y, id, seed)
    return train, valid
