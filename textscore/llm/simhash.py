"""SimHash near-duplicates: fingerprints, and links by bit-sliced comparison.

A fingerprint's 64 bits are stored as 64 planes, one machine word for a block of 64 fingerprints. The distance of one
fingerprint to the whole block is counted plane by plane in carry-save bit counters, and a block is left as soon as
all its distances are beyond the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textscore.llm.common import dropped, slices, sorted_groups, whole_text, written
from textscore.llm.components import components, join_labels

BITS = 64
SEED = 42
BUCKET_ROWS = 4096
MEAN_BUCKET = 64
HASHES_AT_ONCE = 1 << 18
PLANES_BETWEEN_LOOKS = 8
PAIRS_AT_ONCE = 1 << 18


def fingerprint(text: str, shingle: int) -> int:
    """Bits that are set in over half the XXH64 of the shingles; 0 without a word."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), HASHES_AT_ONCE):
        spans = zip(starts[at:at + HASHES_AT_ONCE].tolist(), ends[at:at + HASHES_AT_ONCE].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``id`` and ``fp`` (the 64 bits as a long) of every row; one pass, no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def block_masks(free: list[int], blocks: int, pick: int) -> list[int]:
    """Masks of all choices of ``pick`` out of ``blocks`` near-equal parts of the bit positions."""
    parts = [sum(1 << int(b) for b in part) for part in np.array_split(np.array(free), blocks)]
    return [sum(chosen) for chosen in combinations(parts, pick)]


def plan_masks(fingerprints_: int, radius: int) -> list[int]:
    """Masks such that two fingerprints within the radius agree under one of them.

    With ``radius + p`` parts at most ``radius`` are touched by the differing bits, so ``p`` parts agree. More parts
    mean longer keys; ``p`` is the least that makes the mean bucket small. Every choice finds every pair.
    """
    for pick in range(1, 5):
        masks = block_masks(list(range(BITS)), radius + pick, pick)
        if fingerprints_ >> min(m.bit_count() for m in masks) <= MEAN_BUCKET:
            break
    return masks


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes, 64 rows of one word per 64 fingerprints."""
    words = -(-len(fps) // 64)
    bits = np.zeros((words * 64, BITS), np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def near_pairs(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j that differ in at most ``radius`` bits, some at a time."""
    n = len(fps)
    planes = planes_of(fps)
    words = planes.shape[1]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    asked = np.where(np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T, full, np.uint64(0))
    digits = radius.bit_length()
    start = (1 << digits) - 1 - radius  # a counter that starts here runs over at radius + 1
    step = max(1, PAIRS_AT_ONCE // words)
    for first in range(0, n, step):
        rows = np.arange(first, min(n, first + step))
        q = np.repeat(rows, words)
        w = np.tile(np.arange(words), len(rows))
        ahead = w >= q // 64
        q, w = q[ahead], w[ahead]
        counter = [np.full(len(q), full if start >> d & 1 else np.uint64(0)) for d in range(digits)]
        beyond = np.zeros(len(q), np.uint64)
        for p in range(BITS):
            carry = planes[p, w] ^ asked[p, q]
            for d in range(digits):
                counter[d], carry = counter[d] ^ carry, counter[d] & carry
            beyond |= carry
            if p % PLANES_BETWEEN_LOOKS == PLANES_BETWEEN_LOOKS - 1:
                open_ = beyond != full
                if not open_.all():
                    q, w, beyond = q[open_], w[open_], beyond[open_]
                    counter = [c[open_] for c in counter]
                if not len(q):
                    break
        if not len(q):
            continue
        hit = np.unpackbits((~beyond).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        block, bit = np.nonzero(hit)
        a, b = q[block], w[block] * 64 + bit
        keep = (b > a) & (b < n)
        yield a[keep], b[keep]


def _linker(radius: int):
    """Of each bucket, links that hang every fingerprint on the smallest node of its piece."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in sorted_groups(frames, ["mask", "key", "tile"]):
            if len(group) < 2:
                continue
            group = group.sort_values("node", kind="stable")
            node = group["node"].to_numpy()
            labels = np.arange(len(node))
            for a, b in near_pairs(group["fp"].to_numpy().view(np.uint64), radius):
                labels = join_labels(labels, a, b)
            keep = labels != np.arange(len(node))
            if keep.any():
                yield pd.DataFrame({"a": node[keep], "b": node[labels[keep]]})

    return run


def links_of(nodes: DataFrame, radius: int) -> DataFrame:
    """Links between fingerprints of ``nodes (fp, node)`` with the same components as all pairs within the radius.

    Buckets hold fingerprints that agree under a mask. A bucket that is too large is dealt again under longer masks
    (the differing bits leave one of ``radius + 1`` parts of the other positions alone), and one that stays too
    large is cut into chunks that meet pairwise, so no task holds more than two chunks and no pair is lost.
    """
    spark = nodes.sparkSession
    masks = plan_masks(nodes.count(), radius)
    finer = [m | extra for m in masks for extra in
             block_masks([b for b in range(BITS) if not m >> b & 1], radius + 1, 1)]
    listed = F.array(*[F.struct(F.lit(i).alias("mask"), F.lit(_signed(m)).alias("bits")) for i, m in enumerate(masks)])
    first = nodes.select("fp", "node", F.explode(listed).alias("m")).select(
        "fp", "node", "m.mask", F.col("fp").bitwiseAND(F.col("m.bits")).alias("key"))
    sizes = first.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("rows"))
    hot = sizes.where(F.col("rows") > BUCKET_ROWS).select("mask", "key")
    cold = first.join(hot, ["mask", "key"], "left_anti")
    table = F.broadcast(spark.createDataFrame(  # radius + 1 rows for each of the masks
        [(i // (radius + 1), len(masks) + i, _signed(m)) for i, m in enumerate(finer)], "mask int, sub int, bits long"))
    second = first.join(hot, ["mask", "key"], "left_semi").join(table, "mask").select(
        "fp", "node", F.col("sub").alias("mask"), F.col("fp").bitwiseAND(F.col("bits")).alias("key"))
    half = BUCKET_ROWS // 2
    chunks = second.groupBy("mask", "key").agg(F.ceil(F.count(F.lit(1)) / half).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    low, high = F.least(own, F.col("other")), F.greatest(own, F.col("other"))
    tiled = second.join(chunks, ["mask", "key"]).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "fp", "node", "mask", "key", (low * F.col("chunks") + high).cast("long").alias("tile"))
    rows = cold.select("fp", "node", "mask", "key", F.lit(0).cast("long").alias("tile")).unionByName(tiled)
    dealt = rows.repartition("mask", "key", "tile").sortWithinPartitions("mask", "key", "tile")
    return dealt.mapInPandas(_linker(radius), "a long, b long")


def simhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = 4, radius: int = 4) -> DataFrame:
    """Every row's fingerprint and the smallest id that near-duplicate links lead to.

    Returns ``id_col`` (long), ``fingerprint`` (16 hex digits) and ``component_id``, one row per input row. Texts
    without a word, and null texts, have fingerprint zero and link like any other. Rows with one id are one document, which ties
    the fingerprints of its texts. A row with a null id belongs to the component of its fingerprint and gives no id to it; where a
    fingerprint has null ids only, the component is null. Other columns are left out. No rows give no rows.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = written(fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("node")), "nodes")
    # An id with several texts is one document: it ties their fingerprints.
    several = fps.where("id is not null").groupBy("id").agg(F.min("fp").alias("low"), F.max("fp").alias("high"))
    several = several.where("low <> high").select("id")
    tied = fps.join(several, "id", "left_semi").join(nodes, "fp").select(F.col("id").alias("a"), F.col("node").alias("b"))
    found = components(links_of(nodes, radius).unionByName(tied))
    of_fp = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    hex_ = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(of_fp, "fp", "left").select(
        F.col("id").alias(id_col), hex_.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows whose id is the smallest of their component, with all their columns.

    Rows that repeat an id all stay or all go; a row without an id stays, as nothing shows which one it repeats.
    """
    found = simhash_near_dedup(docs, id_col, text_col, shingle, radius)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
