"""Hard negatives of anchor vectors by the threshold algorithm over sorted lists of components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textscore.llm.common import sorted_groups, written

BLOCK_ROWS = 4096
ANCHORS_AT_ONCE = 512
FIRST_DEPTH = 32
EXACT_DOUBLE = 1 << 53
SCALE = 256
KEPT = 5
#: A negative's score lies between these percentages of its positive's score.
LOW_PERCENT, HIGH_PERCENT = 80, 100


class SortedLists:
    """Rows of a block, and for each dimension their numbers in the order of that component."""

    def __init__(self, rows: np.ndarray):
        most = int(np.abs(rows).max(initial=0))
        exact = most * most * max(1, rows.shape[1]) < EXACT_DOUBLE
        self.rows, self.most, self.exact = rows.astype(np.float64 if exact else np.int64), most, exact
        order = np.argsort(rows, axis=0, kind="stable")
        self.values = np.ascontiguousarray(np.take_along_axis(rows, order, 0).T).astype(np.int64)
        self.order = np.ascontiguousarray(order.T)

    def score(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Inner products of some rows with the anchor, in whole numbers."""
        if self.exact and self.most * int(np.abs(anchor).max(initial=0)) * max(1, len(anchor)) < EXACT_DOUBLE:
            return (self.rows[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.rows[rows].astype(np.int64) @ anchor

    def until(self, anchor: np.ndarray, enough: Callable[[np.ndarray, np.ndarray, int], bool]) -> tuple[np.ndarray, np.ndarray]:
        """Rows met and their scores, when ``enough(rows, scores, threshold)`` holds or all lists are read.

        A list is read from its large end where the anchor's component is positive, from its small end where it is negative. No
        row that was not met can score above the threshold, the score of the last values read. Depth doubles, so that
        the stopping rule is asked a few times only.
        """
        n = len(self.rows)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        if not len(up) and not len(down):
            every = np.arange(n)
            return every, np.zeros(n, np.int64)
        seen, rows, scores = np.zeros(n, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
        read, depth = 0, min(n, FIRST_DEPTH)
        while read < n:
            met = np.zeros(n, bool)
            met[self.order[up, n - depth:n - read].ravel()] = True
            met[self.order[down, read:depth].ravel()] = True
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            rows, scores = np.concatenate((rows, new)), np.concatenate((scores, self.score(new, anchor)))
            threshold = int(anchor[up] @ self.values[up, n - depth]) + int(anchor[down] @ self.values[down, depth - 1])
            if len(rows) == n or enough(rows, scores, threshold):
                break
            read, depth = depth, min(n, 2 * depth)
        return rows, scores


def best(ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the first rows: higher scores come first, ties by smaller id."""
    if len(scores) > most:
        bar = np.partition(scores, -most)[-most]
        places = np.flatnonzero(scores >= bar)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))][:most]


def kth(scores: np.ndarray, most: int) -> int | None:
    return int(np.partition(scores, -most)[-most]) if len(scores) >= most else None


def _halves(group: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray]:
    asks = group["asks"].to_numpy(bool)
    rows = group[~asks]
    return group[asks], rows, np.stack(rows["vector"].to_numpy()).astype(np.int64) if len(rows) else np.zeros((0, 0), np.int64)


def _positives(most: int):
    """Of each anchor, the first rows of its label in a block; the lists hold one label's rows."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in sorted_groups(frames, ["size", "part", "block"]):
            anchors, rows, matrix = _halves(group)
            out = []
            for label in set(anchors["label"]) & set(rows["label"]):
                own = (rows["label"] == label).to_numpy()
                ids, nodes, lists = rows["id"].to_numpy()[own], rows["node"].to_numpy()[own], SortedLists(matrix[own])
                for node, vector in anchors.loc[anchors["label"] == label, ["node", "vector"]].itertuples(index=False):
                    def enough(met, scores, threshold):
                        bar = kth(scores[nodes[met] != node], most)
                        return bar is not None and threshold < bar

                    met, scores = lists.until(np.asarray(vector, np.int64), enough)
                    others = nodes[met] != node
                    met, scores = met[others], scores[others]
                    first = best(ids[met], scores, most)
                    out.append(pd.DataFrame({"anchor": node, "node": nodes[met[first]], "id": ids[met[first]], "score": scores[first]}))
            if out:
                yield pd.concat(out)

    return run


def _negatives(most: int, low: int, high: int):
    """Of each anchor and window of scores, the first rows of other labels in a block."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in sorted_groups(frames, ["size", "part", "block"]):
            anchors, rows, matrix = _halves(group)
            if not len(anchors) or not len(rows):
                continue
            ids, labels, lists, out = rows["id"].to_numpy(), rows["label"].to_numpy(), SortedLists(matrix), []
            for node, label, vector, windows in anchors[["node", "label", "vector", "windows"]].itertuples(index=False):
                other = labels != label

                def inside(scores, positive):
                    return (100 * scores >= low * positive) & (100 * scores <= high * positive)

                def enough(met, scores, threshold):
                    scores = scores[other[met]]
                    for positive in windows:
                        bar = kth(scores[inside(scores, positive)], most)
                        if threshold >= bar if bar is not None else 100 * threshold >= low * positive:
                            return False
                    return True

                met, scores = lists.until(np.asarray(vector, np.int64), enough)
                met, scores = met[other[met]], scores[other[met]]
                for positive in windows:
                    fits = np.flatnonzero(inside(scores, positive))
                    first = fits[best(ids[met[fits]], scores[fits], most)]
                    if len(first):
                        out.append(pd.DataFrame({"anchor": node, "positive_score": positive, "id": ids[met[first]], "score": scores[first]}))
            if out:
                yield pd.concat(out)

    return run


def _first(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The best rows of each key; each task cuts before the shuffle, so a key brings a few rows a block."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _tiles(rows: DataFrame, anchors: DataFrame, parts: DataFrame) -> DataFrame:
    """Every part of the anchors next to every block of the rows, one group a pair: ``size, part, block``."""
    asked = anchors.join(parts, "size").select(
        "size", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "node", "id", "label", "vector", "windows")
    dealt = rows.join(parts, "size").select(
        "size", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("asks"), "node", "id", "label", "vector",
        F.lit(None).cast("array<bigint>").alias("windows"))
    keys = ["size", "part", "block"]
    return asked.unionByName(dealt).repartition(*keys).sortWithinPartitions(*keys)


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   every: int = 100, scale: int = SCALE, positives: int = KEPT, negatives: int = KEPT,
                   low: int = LOW_PERCENT, high: int = HIGH_PERCENT) -> DataFrame:
    """Rows of other labels that score nearly as high with an anchor as one of its positives does.

    Returns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``. Anchors are rows whose id is divisible by
    ``every``; components become ``floor(scale * x)``; a score is the inner product with the anchor. Positives are the
    first ``positives`` other rows of the anchor's label, negatives the first ``negatives`` rows of other labels whose
    score is from ``low`` to ``high`` percent of the positive's. Higher scores come first, ties by smaller id.

    Anchors meet all rows in blocks of bounded size, each pair of a part of the anchors and a block once for positives and once for
    negatives; a block returns a few rows per anchor. A hot label only makes more blocks.

    No part take: null ids, null labels, null vectors, null or non-finite components. Rows that repeat whole count once; an id with several
    vectors or labels is several rows. Vectors meet those of their own length. A positive score below zero leaves no room for
    negatives. Other columns are left out; without rows or anchors there are no rows.
    """
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    whole = good.select("id", "label", F.transform("vector", lambda x: F.floor(x * scale).cast("long")).alias("vector")).distinct()
    table = written(whole.withColumns({"size": F.size("vector"), "node": F.monotonically_increasing_id()}), "rows")
    asks = F.col("id") % every == 0
    parts = table.groupBy("size").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"),
        F.ceil(F.sum(asks.cast("long")) / ANCHORS_AT_ONCE).cast("int").alias("parts")).where("parts > 0")
    anchors = table.where(asks).withColumn("windows", F.lit(None).cast("array<bigint>"))
    found = _tiles(table, anchors, parts).mapInPandas(_positives(positives), "anchor long, node long, id long, score long")
    near = written(_first(found, ["anchor"], positives).drop("rank"), "positives")
    windows = near.groupBy(F.col("anchor").alias("node")).agg(F.collect_set("score").alias("windows"))
    asked = anchors.drop("windows").join(windows, "node")
    found = _tiles(table, asked, parts).mapInPandas(
        _negatives(negatives, low, high), "anchor long, positive_score long, id long, score long")
    kept = written(_first(found, ["anchor", "positive_score"], negatives), "negatives")
    named = near.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = table.where(asks).select(F.col("node").alias("anchor"), F.col("id").alias("anchor_id"))
    return named.join(kept, ["anchor", "positive_score"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
