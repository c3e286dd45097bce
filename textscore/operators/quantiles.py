"""Exact quantiles per group, with linear interpolation between neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textscore.operators.selection import column_order
from textscore.session import pin_small, via_table


def exact_quantiles(df: DataFrame, by: Sequence[str], col: str, probs: Sequence[float], out: str = "q") -> DataFrame:
    """One row per group with its quantiles as an array.

    Equal values are counted first, on the map side, so a value that most rows
    share costs one row; the counts are written once. Ranks are then found range by
    range, by the same steps and the same formula at every size.
    """
    by = list(by)
    value = F.col(col).cast("double")
    rows = df.select(*by, value.alias("_v")).where(F.col("_v").isNotNull())
    for name in by:
        rows = rows.where(F.col(name).isNotNull())
    counts = via_table(rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")), "counts")
    return _by_ranks(counts, by, probs, out)


def _by_ranks(counts: DataFrame, by: list[str], probs: Sequence[float], out: str) -> DataFrame:
    """Quantiles from value counts without bringing a group to one task.

    Values are dealt into ranges; the counts per range give the rank at which
    each range starts, and running sums inside a range give the ranks of a value.
    """
    ranged = counts.withColumn("_bucket", column_order(counts, "_v").bucket)
    cells = ranged.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_c"))
    in_order = Window.partitionBy(*by).orderBy("_bucket")
    starts = cells.select(
        *by, "_bucket", (F.sum("_c").over(in_order) - F.col("_c")).alias("_before"),
        F.sum("_c").over(Window.partitionBy(*by)).alias("_total"),
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy("_v")
    placed = (
        ranged.join(pin_small(starts), [*by, "_bucket"])
        .withColumn("_end", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_start", F.col("_end") - F.col("_n"))
    )

    def value_at(rank):
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col("_v")))

    picked, results = [], []
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("_total") - 1)
        picked += [
            value_at(F.floor(place)).alias(f"_lo{i}"), value_at(F.ceil(place)).alias(f"_hi{i}"),
            F.max(place - F.floor(place)).alias(f"_part{i}"),
        ]
        results.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_part{i}"))
    return placed.groupBy(*by).agg(*picked).select(*by, F.array(*results).alias(out))
