"""Vector compression by codebooks of parts; nearest entries found by sliced and intersected bit masks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textscore.llm.common import dropped, written

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Above this size of a scaled component, squared distances would not fit in whole numbers of 64 bits.
LARGEST = 1 << 26


class EntryMasks:
    """The entries of one codebook, as masks over their coordinates in sorted order.

    ``prefix[d][k]`` has the bits of the ``k`` entries with the smallest coordinates ``d``, so that the entries within a
    range of that coordinate are one exclusive-or of two masks. The ands of all coordinates leave the entries in a box.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        count, dims = self.entries.shape
        order = np.argsort(self.entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.entries, order, 0)
        self.prefix = np.zeros((dims, count + 1, -(-count // 64)), np.uint64)
        for d in range(dims):
            for k, e in enumerate(order[:, d]):
                self.prefix[d, k + 1] = self.prefix[d, k]
                self.prefix[d, k + 1, e // 64] |= np.uint64(1) << np.uint64(e % 64)
        gaps = [np.sort(np.square(self.entries - e).sum(1))[:2][-1] for e in self.entries]
        self.radius = max(1, int(np.sqrt(np.median(gaps))))

    def in_box(self, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries that differ from each point by at most its radius in every coordinate."""
        found = np.broadcast_to(self.prefix[0, -1], (len(points), self.prefix.shape[2])).copy()
        for d in range(points.shape[1]):
            low = np.searchsorted(self.sorted[:, d], points[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[:, d], points[:, d] + radius, "right")
            found &= self.prefix[d, low] ^ self.prefix[d, high]
        return found

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance of each point, the lower index on a tie.

        A point is settled when its best candidate lies within its radius: entries outside the box are farther than that. Else the
        box grows to the best candidate, or doubles if it was empty.
        """
        points = points.astype(np.int64)
        code, error = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        left, radius = np.arange(len(points)), np.full(len(points), self.radius, np.int64)
        while len(left):
            at = points[left]
            masks = self.in_box(at, radius)
            best, of = np.full(len(left), np.iinfo(np.int64).max), np.zeros(len(left), np.int64)
            for e, entry in enumerate(self.entries):
                rows = np.flatnonzero(masks[:, e // 64] >> np.uint64(e % 64) & np.uint64(1))
                away = np.square(at[rows] - entry).sum(1)
                closer = away < best[rows]
                best[rows[closer]], of[rows[closer]] = away[closer], e
            met = best < np.iinfo(np.int64).max
            settled = met & (best <= radius * radius)
            code[left[settled]], error[left[settled]] = of[settled], best[settled]
            grown = np.where(met, np.sqrt(np.where(met, best, 0)).astype(np.int64) + 1, radius * 2)
            left, radius = left[~settled], grown[~settled]
        return code, error


def _whole(scale: int):
    """Rows with finite vectors, their components as whole numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            flat = np.floor(scale * lists.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            if np.abs(flat[np.isfinite(flat)]).max(initial=0) >= LARGEST:
                raise ValueError(f"a component times {scale} is {LARGEST} or more: distances would not be exact")
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
            good = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False) & (bad[ends[1:]] == bad[ends[:-1]]))
            keep = np.repeat(np.isin(np.arange(len(sizes)), good), sizes)
            offsets = np.concatenate(([0], np.cumsum(sizes[good]))).astype(np.int32)
            whole = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[keep].astype(np.int32)))
            kept = batch.take(pa.array(good))
            yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("label"), whole], ["id", "label", "vector"])

    return run


def _matrix(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """Vectors of a batch as rows x parts x coordinates."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, parts, -1) if batch.num_rows else np.zeros((0, parts, 0), np.int32)


def _sums(books: np.ndarray):
    """Of each part and entry of a task: how many parts it has and their sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [EntryMasks(b) for b in books]
        count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for p, points in enumerate(_matrix(batch, len(books)).transpose(1, 0, 2) if batch.num_rows else ()):
                code, _ = masks[p].nearest(points)
                count[p] += np.bincount(code, minlength=books.shape[1])
                np.add.at(total[p], code, points)
        p, e = np.nonzero(count)
        if len(p):
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(count[p, e]),
                "total": pa.array(list(total[p, e]), pa.list_(pa.int64()))})

    return run


def _codes(books: np.ndarray):
    """Codes and errors of vectors: two hex digits per part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, digits = [EntryMasks(b) for b in books], np.array([f"{e:02x}" for e in range(books.shape[1])], object)
        for batch in batches:
            if not batch.num_rows:
                continue
            code, error = np.full(batch.num_rows, "", object), np.zeros(batch.num_rows, np.int64)
            for p, points in enumerate(_matrix(batch, len(books)).transpose(1, 0, 2)):
                of, away = masks[p].nearest(points)
                code, error = code + digits[of], error + away
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    return run


def next_books(whole: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry replaced by the floor of the mean of its parts; unused entries stay. One pass, few rows a task."""
    found = whole.mapInArrow(_sums(books), "part int, entry int, n long, total array<bigint>")
    slots = found.select("part", "entry", "n", F.posexplode("total").alias("at", "x")).groupBy("part", "entry", "at").agg(
        F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out = books.copy()
    for row in slots.collect():
        out[row["part"], row["entry"], row["at"]] = int(row["x"]) // int(row["n"])
    return out


def part_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
               scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Codes of vectors whose parts are named by the nearest entries of codebooks learnt here.

    Returns one row per vector that takes part: ``id_col, code`` (two hex digits a part), ``error`` (squared distances summed over
    the parts), ``label_error`` (errors summed over equal labels, nulls together) and ``codebooks_sha256``.

    Components become ``floor(scale * x)``. The codebook of a part starts as that part of the vectors with the ``entries`` smallest
    ids (fewer if there are fewer; of an id with several vectors the smallest one) and is moved ``rounds`` times to the
    floors of means. The driver holds codebooks only; a task returns one sum per part and entry.

    Left out: null vectors, null or non-finite components, and vectors whose length is no positive multiple of ``parts`` or differs from that of
    the smallest id. A null id is coded but starts no codebook. Rows that repeat count each. Other columns are left out. No
    rows give no rows. A component too large for exact distances fails.
    """
    if entries > 256:
        raise ValueError("two hex digits name at most 256 entries")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
                          F.col(vector_col).cast("array<double>").alias("vector"))
    kind = rows.schema["label"].dataType.simpleString()
    fits = (F.size("vector") > 0) & (F.size("vector") % parts == 0)
    whole = written(rows.where(fits).mapInArrow(_whole(scale), f"id long, label {kind}, vector array<int>"), "whole")
    known = whole.where("id IS NOT NULL")
    start = known.select("id").distinct().orderBy("id").limit(entries)
    start = known.join(F.broadcast(start), "id").groupBy("id").agg(F.min("vector").alias("vector")).orderBy("id").collect()
    if not start:
        dropped(whole)
        empty = f"{id_col} long, code string, error long, label_error long, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], empty)
    dims = len(start[0]["vector"])
    whole = whole.where(F.size("vector") == dims)
    books = np.array([r["vector"] for r in start if len(r["vector"]) == dims], np.int64).reshape(-1, parts, dims // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        books = next_books(whole, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = written(whole.mapInArrow(_codes(books), f"id long, label {kind}, code string, error long"), "codes")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(totals, coded["label"].eqNullSafe(totals["of"])).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
