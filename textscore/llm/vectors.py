"""Embedding near-duplicates: int8 tile products with error bounds, then full precision where they leave doubt."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textscore.llm.common import sorted_groups, written
from textscore.llm.components import components, join_labels

CHUNK_ROWS = 2048
ROWS_AT_ONCE = 512
PAIRS_AT_ONCE = 1 << 16
ROUNDING = 1e-9
EXACT_FLOAT32 = 1 << 24


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, their scales and the length of what each code leaves out of its unit vector."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    left = np.sqrt(np.square(unit - codes * scale[:, None]).sum(1))
    return codes, scale, left


def doubtful(codes, scale, left, rows: slice, cols: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose cosine may reach the threshold.

    With u = s q + e: |u.v - s t (q.r)| <= |e| |v| + |s q| |f| <= |e| + (1 + |e|) |f|. Products of codes are whole
    numbers that float32 holds exactly while 127 * 127 * dimension stays below 2 ** 24 (float64 beyond).
    """
    kind = np.float32 if 127 * 127 * codes.shape[1] < EXACT_FLOAT32 else np.float64
    product = (codes[rows].astype(kind) @ codes[cols].astype(kind).T).astype(np.float64)
    product *= scale[rows, None]
    product *= scale[None, cols]
    product += left[rows, None]
    product += (1 + left[rows, None]) * left[None, cols]
    return np.nonzero(product >= threshold - ROUNDING)


def cosines(vectors: np.ndarray, norms: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", vectors[a], vectors[b]) / (norms[a] * norms[b])


def near_pairs(vectors: np.ndarray, first: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine at or above the threshold: across the two chunks, or within the only one."""
    vectors = vectors / np.abs(vectors).max(1)[:, None]
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    codes, scale, left = quantised(vectors / norms[:, None])
    split = int(first.sum())
    within = split == len(first)
    for at in range(0, split, ROWS_AT_ONCE):
        rows = slice(at, min(split, at + ROWS_AT_ONCE))
        from_ = at if within else split
        a, b = doubtful(codes, scale, left, rows, slice(from_, len(first)), threshold)
        a, b = a + at, b + from_
        if within:
            a, b = a[b > a], b[b > a]
        for k in range(0, len(a), PAIRS_AT_ONCE):
            i, j = a[k:k + PAIRS_AT_ONCE], b[k:k + PAIRS_AT_ONCE]
            linked = cosines(vectors, norms, i, j) >= threshold
            yield i[linked], j[linked]


def _tiles(threshold: float):
    """Of each tile: how many vectors each one links to, and the smallest vector of its piece."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in sorted_groups(frames, ["label", "size", "low", "high"]):
            first = (group["chunk"] == group["low"]).to_numpy()
            if len(group) < 2 or (group["low"].iat[0] != group["high"].iat[0] and first.all()):
                continue
            order = np.lexsort((group["node"].to_numpy(), ~first))
            group, first = group.iloc[order], first[order]
            node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
            ranked = np.argsort(node, kind="stable")
            rank = np.empty_like(ranked)
            rank[ranked] = np.arange(len(node))
            labels, links = np.arange(len(node)), np.zeros(len(node), np.int64)
            for a, b in near_pairs(np.stack(group["vector"].to_numpy()).astype(np.float64), first, threshold):
                links += np.bincount(a, copies[b], len(node)).astype(np.int64)
                links += np.bincount(b, copies[a], len(node)).astype(np.int64)
                labels = join_labels(labels, rank[a], rank[b])
            keep = links > 0
            if keep.any():
                root = node[ranked][labels[rank]]
                yield pd.DataFrame({"node": node[keep], "links": links[keep], "root": root[keep]})

    return run


def embedding_near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                         label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """Links between vectors of one label with cosine at or above the threshold, all of them and no other.

    Returns one row per input row: ``id_col``, ``n_links`` (other vectors linked directly), ``component_id`` (smallest
    id reachable) and ``kept`` (id = component). Equal vectors are compared once and counted with their copies. The others of a label
    are dealt into chunks of bounded size by a hash, every two chunks meet in one tile, and a tile returns counts
    and one link per vector, never pairs.

    Rows that link with nothing: null id, null label, null or empty vector, null or non-finite component, all zeros. They have no
    links and are their own component (null, and kept false, for a null id). Vectors of different lengths do not
    link. Rows that repeat id and vector count as copies of the vector. An id with several vectors has a row for each, with the
    links and the component of that vector: ids do not tie vectors together. Other columns are left out. No rows give no rows.
    """
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite
                        & F.exists("vector", lambda x: x != 0), F.lit(False))
    good = rows.where(usable)
    distinct = written(good.groupBy("label", "vector").agg(
        F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")).withColumn("size", F.size("vector")), "vectors")
    chunks = distinct.groupBy("label", "size").agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("chunks"))
    tiles = distinct.join(chunks, ["label", "size"]).withColumn(
        "chunk", F.pmod(F.xxhash64("vector"), F.col("chunks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        F.col("label").cast("string").alias("label"), "size", F.least("chunk", "other").alias("low"),
        F.greatest("chunk", "other").alias("high"), "chunk", "node", "copies", "vector")
    keys = ["label", "size", "low", "high"]
    dealt = tiles.repartition(*keys).sortWithinPartitions(*keys)
    found = written(dealt.mapInPandas(_tiles(threshold), "node long, links long, root long"), "links")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    pieces = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = distinct.drop("size").join(linked, "node", "left").join(pieces, "node", "left")
    known = known.select("label", "vector", "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                         F.coalesce("component", "node").alias("component_id"))
    same = good.join(known, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return same.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
