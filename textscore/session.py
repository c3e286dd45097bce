"""Session helpers: shared scratch space and bounded tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 100_000
ROWS_PER_PIECE = 20

_made: dict = {}
_paths: list[str] = []


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions the session is set up for."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="textscore-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    _paths.append(f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _paths[-1]


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder wherever Spark can write."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def clear_scratch(spark: SparkSession) -> int:
    """Delete all intermediate tables of this session and forget what was kept in them.

    Frames that still read such a table cannot be used afterwards. Gives the number of paths.
    """
    _made.clear()
    gone = len(_paths)
    while _paths:
        delete_path(spark, _paths.pop())
    return gone


def scratch_mark() -> int:
    """A place in the list of this session's scratch paths, for :func:`drop_scratch`."""
    return len(_paths)


def drop_scratch(spark: SparkSession, mark: int, keep: str) -> None:
    """Delete the scratch paths made since ``mark`` but ``keep``, when nothing reads them any more."""
    for path in _paths[mark:]:
        if path != keep:
            delete_path(spark, path)
    _paths[mark:] = [keep]


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of the queries run inside go as soon as each is done, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def via_table(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write ``df`` to shared storage and read it back, cutting its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made_once(spark: SparkSession, key: tuple, build: Callable):
    """The result of ``build()``, made once per application and key. :func:`clear_scratch` forgets it."""
    where = (spark.sparkContext.applicationId, *key)
    if where not in _made:
        _made[where] = build()
    return _made[where]


def pin_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Run a small summary once and hand it on as a local, broadcast table.

    At most ``max_rows + 1`` rows reach the driver. A result that is larger is
    not used from the driver at all: it is written once and comes back as a table. Joins with it then
    shuffle, and adaptive execution splits the partition of a group that holds many rows.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return via_table(df, "summary")
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """Deal a table that only a few tasks would read over all cores.

    A small table often lies in one file with one row group, and then all
    work on its texts would run in one task. A table with more pieces than cores
    comes back as it is, so large input is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() > 4 * cores:
        return df
    pieces = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    wanted = min(cores, sum(pieces) // ROWS_PER_PIECE)
    return df if len(pieces) >= wanted else df.repartition(wanted, key)
