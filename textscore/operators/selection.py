"""Exact ranks, cut-offs and positions without sorting a whole group in one task.

A plain ``row_number()`` over a category sends all rows of that category to one
task, and a global one sends everything there. Here the rows are first dealt
into buckets that follow the wanted order, the rows of each (group, bucket)
cell are counted with map-side combine, and the counts give the rank at which
each cell starts.

* A cut-off ("the first n rows of each group") then needs a sort only inside
  the one cell that the cut falls into. All other rows are decided by one
  comparison, so the data itself is never shuffled.
* A position of every row needs one shuffle by cell, not by group.

The bucket limits decide only how even the cells are, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textscore.functions.hashing import hash_key
from textscore.session import parallelism, pin_small

MAX_RANGE_BUCKETS = 16_384
ROWS_PER_BUCKET = 1_000_000
GROUP = "_group"


@dataclass(frozen=True)
class RowOrder:
    """A total order of rows: ``bucket`` never falls as ``key`` rises."""

    key: Column
    bucket: Column


def hash_order(df: DataFrame, id: str, seed: int | str) -> RowOrder:
    """Seeded random order. The leading digits of the hash are the buckets, the more of them the more rows there are."""
    key = hash_key(F.col(id), seed)
    buckets = max(parallelism(df.sparkSession), df.count() // ROWS_PER_BUCKET)
    digits = max(1, round(math.log(buckets, 16)))
    return RowOrder(F.struct(key.alias("h"), F.col(id).alias("id")), F.substring(key, 1, digits))


def column_order(df: DataFrame, col: str) -> RowOrder:
    """Ascending order of a numeric key column.

    Bucket limits are approximate quantiles, fetched once and then fixed as
    literals, so that every later pass over the data deals it the same way. There are as many buckets as
    the session has shuffle partitions, and more where they would hold very many rows.
    """
    rows = df.agg(F.count(col)).first()[0]
    n = min(MAX_RANGE_BUCKETS, max(parallelism(df.sparkSession), rows // ROWS_PER_BUCKET))
    probs = [i / n for i in range(1, n)]
    limits = df.agg(F.percentile_approx(col, probs, 10 * max(n, 1000))).first()[0] if probs else []
    limits = limits or []
    return RowOrder(F.col(col), range_bucket(F.col(col), sorted(set(limits))))


def range_bucket(col: Column, limits: Sequence) -> Column:
    """Number of limits that are not above the value, found in two short steps."""
    if not limits:
        return F.lit(0)
    width = max(1, int(len(limits) ** 0.5))
    blocks = [limits[i:i + width] for i in range(0, len(limits), width)]

    def passed(values: Column) -> Column:
        return F.size(F.filter(values, lambda v: v <= col))

    heads = F.array(*[F.lit(b[0]) for b in blocks])
    tables = F.array(*[F.array(*[F.lit(v) for v in b]) for b in blocks])
    block = passed(heads)
    inside = passed(F.get(tables, F.greatest(block - 1, F.lit(0))))
    return F.when(block == 0, 0).otherwise((block - 1) * width + inside)


def _grouped(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if by:
        return df, list(by)
    return df.withColumn(GROUP, F.lit(0)), [GROUP]


def _cells(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows per cell, the rank at which the cell starts, and group sizes."""
    counts = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    in_order = Window.partitionBy(*by).orderBy("_bucket")
    return (
        counts
        .withColumn("_before", F.sum("_n").over(in_order) - F.col("_n"))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*by)))
    )


def group_sizes(df: DataFrame, by: str) -> DataFrame:
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("_total"))


def split_at(
    df: DataFrame,
    by: Sequence[str],
    order: RowOrder,
    ranks: Sequence[Column | int],
    part: str = "part",
) -> DataFrame:
    """Cut each group at given ranks and number the parts from 0.

    ``ranks`` are counts of rows before each cut; as columns they may use
    ``_total``, the size of the group. The input is read three times (count,
    boundary cells, result), which is cheaper than one sort of it. A cut between
    two rows of one key fails, as it could not keep exactly as many rows as asked for.
    """
    df, by = _grouped(df, by)
    rows = df.select(*by, order.bucket.alias("_bucket"), order.key.alias("_key"))
    wanted = F.array(*[
        F.struct(F.lit(i).alias("cut"), (F.lit(r) if isinstance(r, int) else r).cast("bigint").alias("rank"))
        for i, r in enumerate(ranks)
    ])
    hit = (
        _cells(rows, by)
        .select("*", F.inline(wanted))
        .where(
            ((F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_before") + F.col("_n")))
            | ((F.col("rank") <= 0) & (F.col("_before") == 0))
        )
        .select(*by, "_bucket", "cut", (F.col("rank") - F.col("_before")).alias("need"))
    )
    hit = pin_small(hit)
    inside = Window.partitionBy(*by, "_bucket", "cut").orderBy("_key")
    tied = F.raise_error(F.lit("the order key is not unique at a cut"))
    last_keys = (
        rows.join(hit.where("need > 0"), [*by, "_bucket"])
        .withColumn("_rn", F.row_number().over(inside)).withColumn("_next", F.lead("_key").over(inside))
        .where(F.col("_rn") == F.col("need"))
        .select(*by, "cut", F.when(F.coalesce(F.col("_key") != F.col("_next"), F.lit(True)), F.col("_key")).otherwise(tied).alias("_last"))
    )
    marks = []
    for i in range(len(ranks)):
        marks.append(F.max(F.when(F.col("cut") == i, F.col("_last"))).alias(f"_last{i}"))
        marks.append(F.max((F.col("cut") == i) & F.col("_last").isNull()).alias(f"_none{i}"))
    empty = hit.where("need <= 0").select(*by, "cut")
    cuts = last_keys.unionByName(empty, allowMissingColumns=True).groupBy(*by).agg(*marks)
    columns = [c for c in df.columns if c != GROUP]
    if by == [GROUP]:
        found = cuts.first()
        known = [
            (_literal(found and found[f"_none{i}"]), _literal(found and found[f"_last{i}"]))
            for i in range(len(ranks))
        ]
    else:
        df = df.join(pin_small(cuts), by, "left")
        known = [(F.col(f"_none{i}"), F.col(f"_last{i}")) for i in range(len(ranks))]
    passed = F.lit(0)
    for none, last in known:
        behind = F.lit(False) if last is None else F.coalesce(order.key > last, F.lit(False))
        passed = passed + (F.coalesce(F.lit(False) if none is None else none, F.lit(False)) | behind).cast("int")
    return df.select(*columns, passed.alias(part))


def _literal(value) -> Column | None:
    """A fetched key as a literal; a struct key field by field."""
    if isinstance(value, Row):
        return F.struct(*[F.lit(v).alias(k) for k, v in value.asDict().items()])
    return None if value is None else F.lit(value)


def keep_first(df: DataFrame, by: Sequence[str], order: RowOrder, n: Column | int) -> DataFrame:
    """The first ``n`` rows of each group in the given order."""
    return split_at(df, by, order, [n], part="_part").where("_part = 0").drop("_part")


def positions(df: DataFrame, order: RowOrder, by: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """0-based position of every row inside its group, without gaps."""
    columns = df.columns
    df, by = _grouped(df, by)
    rows = df.withColumn("_bucket", order.bucket).withColumn("_key", order.key)
    starts = pin_small(_cells(rows, by).select(*by, "_bucket", "_before"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_key")
    return rows.join(starts, [*by, "_bucket"]).select(
        *columns, (F.col("_before") + F.row_number().over(inside) - 1).alias(name)
    )


def positions_after(df: DataFrame, first: str, order: RowOrder, name: str = "pos") -> DataFrame:
    """0-based position in the order (``first``, key) over the whole table.

    ``first`` has few distinct values compared with the rows (a length, a
    score); their counts alone are summed up in one place.
    """
    counts = df.groupBy(first).agg(F.count(F.lit(1)).alias("_n"))
    running = F.sum("_n").over(Window.orderBy(first)) - F.col("_n")
    starts = pin_small(counts.select(first, running.alias("_start")))
    inside = positions(df, order, [first], "_inside")
    return inside.join(starts, first).select(
        *df.columns, (F.col("_start") + F.col("_inside")).alias(name)
    )
