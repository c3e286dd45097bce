"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textscore.session import scratch_path

ROWS_AT_ONCE = 256
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text_col: str) -> Column:
    """The text as a string; a null text counts as empty."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder: later reads do not compute it again.

    Files on shared storage outlive executors, so a lost one costs its running tasks only. Shuffle files of the
    write are of no use once it has ended and go at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator, rows: int = ROWS_AT_ONCE) -> Iterator:
    """Arrow batches in pieces of few rows, so that a task holds few texts as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sorted_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of a partition sorted by ``keys``, each whole, also where it spans batches."""
    rest: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        values = [frame[k].to_numpy() for k in keys]
        new = np.zeros(len(frame), bool)
        for v in values:
            new[1:] |= v[1:] != v[:-1]
        cuts = np.flatnonzero(new)
        if rest and any(rest[-1][k].iat[-1] != v[0] for k, v in zip(keys, values)):
            yield pd.concat(rest) if len(rest) > 1 else rest[0]
            rest = []
        if not len(cuts):
            rest.append(frame)
            continue
        rest.append(frame.iloc[: cuts[0]])
        yield pd.concat(rest) if len(rest) > 1 else rest[0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield frame.iloc[a:b]
        rest = [frame.iloc[cuts[-1]:]]
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether a row belongs to the fold that learning must not see; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def label_sample(labels: DataFrame, id_col: str, label_col: str, folds: int, fold: int, most: int) -> DataFrame:
    """At most ``most`` labelled rows outside the held-out fold, the first by a hash of the id: ``id, label``.

    Labels other than 0 and 1, null ids and ids with contradicting labels teach nothing.
    """
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col, folds, fold))
    rows = rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("other"))
    rows = rows.where("label = other").select("id", "label")
    return rows.orderBy(F.xxhash64("id"), "id").limit(most)
