"""Connected components of links, as joins and grouped minima; links never reach the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textscore.llm.common import dropped, written

ROWS_IN_TASK = 1_000_000


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the pairs ``(a, b)`` added to a labelling by smallest indices."""
    while len(a):
        la, lb = labels[a], labels[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        apart = low != high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(labels, high[apart], low[apart])
        while True:
            further = labels[labels]
            if (further == labels).all():
                break
            labels = further
    return labels


def _contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of a task as stars around the smallest node of each piece."""
    def star(held: list[pd.DataFrame]) -> pd.DataFrame:
        links = pd.concat(held)
        ids, index = np.unique(links[["a", "b"]].to_numpy().ravel(), return_inverse=True)
        index = index.reshape(-1, 2)
        labels = join_labels(np.arange(len(ids)), index[:, 0], index[:, 1])
        keep = labels != np.arange(len(ids))
        return pd.DataFrame({"a": ids[keep], "b": ids[labels[keep]]})

    held: list[pd.DataFrame] = []
    rows = 0
    for frame in frames:
        held.append(frame)
        rows += len(frame)
        if rows >= ROWS_IN_TASK:
            yield star(held)
            held, rows = [], 0
    if held:
        yield star(held)


def contracted(links: DataFrame) -> DataFrame:
    """Links ``(a, b)`` with the same components, at most one per node in each task."""
    return links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInPandas(_contract, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """Node and smallest node of its component, for every node of ``links (a, b)``.

    Tasks first contract the links that they hold. Large-star and small-star rounds then hang every node on the
    smallest one of its piece until nothing changes. A round is grouped minima (combined before the shuffle) and a
    join, which adaptive execution splits at a hub. Each round is written to the shared folder, which cuts the lineage.
    Empty input gives an empty table; links from a node to itself and repeated links change nothing.
    """
    state = written(contracted(links.where("a <> b")).distinct(), "links")
    before = None
    while True:
        size = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if size[0] == 0 or tuple(size) == before:
            return state.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = tuple(size)
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(down, "a")
        small = small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        after = written(contracted(small.unionByName(down.select("a", F.col("low").alias("b")))).distinct(), "links")
        dropped(state)
        state = after
