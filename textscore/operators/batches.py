"""Length-bucketed, padded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textscore.functions.hashing import hash_key
from textscore.functions.text import PADDING_ID
from textscore.operators.selection import column_order, positions_after

BATCH_SIZE = 16


def _size(ids: str) -> Column:
    return F.coalesce(F.size(ids), F.lit(0))


def length_order(df: DataFrame, ids: str, id: str, name: str = "pos") -> DataFrame:
    """Position in the stable ascending order of token counts. NULL counts as no tokens.

    The result has the position of each row and is itself not globally
    sorted; ``orderBy(name)`` shows it in order.
    """
    sized = df.withColumn("n_tokens", _size(ids))
    return positions_after(sized, "n_tokens", column_order(sized, id), name)


def bucket_batches(
    df: DataFrame, ids: str, id: str, batch_size: int = BATCH_SIZE,
    shuffle: bool = True, drop_tail: bool | None = None, seed: int = 0,
) -> DataFrame:
    """Group rows of like length into batches.

    Adds ``pos``, ``n_tokens``, ``batch_id`` and ``batch_key``. With ``shuffle`` the key
    orders the batches at random and the last, partial batch is dropped
    unless ``drop_tail`` says otherwise; without it the key keeps the length order.
    """
    drop_tail = shuffle if drop_tail is None else drop_tail
    placed = length_order(df, ids, id).withColumn("batch_id", F.floor(F.col("pos") / batch_size).cast("bigint"))
    if drop_tail:
        full = df.select(id).count() // batch_size
        placed = placed.where(F.col("batch_id") < full)
    key = hash_key(F.col("batch_id"), seed) if shuffle else F.lpad(F.col("batch_id").cast("string"), 19, "0")
    return placed.withColumn("batch_key", key)


def batch_count(df: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Batches with the partial one and without it."""
    n = F.count(F.lit(1))
    return df.agg(
        F.ceil(n / batch_size).cast("bigint").alias("batches_ceiling"),
        F.floor(n / batch_size).cast("bigint").alias("batches_full"),
    )


def _padded(ids: Column, length: Column) -> Column:
    known = F.coalesce(ids, F.array().cast("array<int>"))
    return F.concat(known, F.array_repeat(F.lit(PADDING_ID).cast("int"), length - F.size(known)))


def pad_to_batch_max(df: DataFrame, ids: str, batch: str = "batch_id", out: str | None = None) -> DataFrame:
    """Pad every row to the longest of its batch. A batch is small by design."""
    longest = F.max(_size(ids)).over(Window.partitionBy(batch))
    return (
        df.withColumn("_longest", longest)
        .withColumn(out or ids, _padded(F.col(ids), F.col("_longest")))
        .drop("_longest")
    )


def padding_mask(df: DataFrame, ids: str, out: str = "mask") -> DataFrame:
    return df.withColumn(out, F.transform(ids, lambda i: i == PADDING_ID))
