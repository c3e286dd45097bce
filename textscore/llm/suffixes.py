"""Removal of byte strings that stand earlier in the corpus, by buckets of q-grams refined through bucket pointers.

A bucket is a set of places whose next q bytes are equal, named by a 64-bit mix of these bytes. Buckets are refined as
in suffix sorting: the name at depth 2q is made of the name at depth q here and of the name at depth q a later offset further
on, and so on up to the length of the strings sought. Initial buckets are kept for sampled places only. Each window takes the place in
it whose q-gram has the least name, so equal windows take equal places, and windows in a row that share their place
are one run. Runs are sorted by initial bucket, then by their refined name: equal neighbours are repeats as a whole.
Buckets that hold different runs are refined once more, window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textscore.llm.common import slices, whole_text, written

LENGTH = 100
GRAM = 50
CHUNK_BYTES = 1 << 19
COLLAPSE_ROWS = 1 << 18
LAST_ID = (1 << 63) - 1

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_S29, _S31, _S32, _S33 = (np.uint64(s) for s in (29, 31, 32, 33))


def mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A name for each pair of names; the order of the two counts."""
    out = y * _B
    turned = out << _S31
    out >>= _S33
    out |= turned
    out ^= x * _A
    out ^= out >> _S29
    out *= _C
    out ^= out >> _S32
    return out


def refined(names: np.ndarray, offset: int) -> np.ndarray:
    """Names at the depth that is reached by following the pointer at a later offset."""
    return mixed(names[:-offset], names[offset:])


@dataclass
class Names:
    """Bucket names of every place of a buffer at the depth of the q-gram and of the whole window."""

    gram: np.ndarray
    window: np.ndarray


def bucket_names(data: np.ndarray) -> Names:
    """The first names are the next 8 bytes themselves; then depths 16, 32, by an overlap 50 (the q-gram), and 100."""
    eight = np.empty(len(data) - 7, "<u8")
    for k in range(8):
        eight[k::8] = data[k:k + (len(data) - k) // 8 * 8].view("<u8")
    eight = mixed(eight, eight)
    gram = refined(refined(refined(eight, 8), 16), GRAM - 32)
    window = refined(gram, LENGTH - GRAM)
    return Names(gram, window)


def least_places(gram: np.ndarray) -> np.ndarray:
    """For each window the first of its places whose q-gram has the least name."""
    value, place, width = gram, np.arange(len(gram), dtype=np.int32), 1
    target = LENGTH - GRAM + 1
    while width < target:
        step = min(width, target - width)
        later = value[step:] < value[:-step]
        place = np.where(later, place[step:], place[:-step])
        value = np.minimum(value[step:], value[:-step])
        width += step
    return place


@dataclass
class Runs:
    """Runs of windows: number of the text, first window, how many, initial bucket and refined name."""

    text: np.ndarray
    low: np.ndarray
    size: np.ndarray
    bucket: np.ndarray
    name: np.ndarray


def runs_of(texts: list[bytes], origins: list[int]) -> Runs:
    """Runs of texts that lie one after the other in a buffer; windows over the seam of two texts are left out.

    ``origins``: where each piece starts in its text, for texts that come in pieces.
    """
    none = np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < LENGTH:
        return Runs(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    ends = np.cumsum([len(t) for t in texts])
    names = bucket_names(data)
    places = least_places(names.gram)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[: len(places)]
    inside = np.flatnonzero(np.arange(len(places)) + LENGTH <= ends[text])
    if not len(inside):
        return Runs(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    taken = places[inside]
    first = np.flatnonzero(np.concatenate(([True], (taken[1:] != taken[:-1]) | (inside[1:] != inside[:-1] + 1))))
    last = np.concatenate((first[1:], [len(inside)])) - 1
    low, high, place = inside[first], inside[last], taken[first].astype(np.int64)
    size = high - low + 1
    shape = (size + (place - low) * LENGTH).astype(np.uint64)
    name = mixed(mixed(names.window[low], names.window[high]), shape)  # both ends of a run cover all its bytes
    of = text[low]
    starts = (ends - [len(t) for t in texts])[of] - np.array(origins, np.int64)[of]
    return Runs(of, low - starts, size, names.gram[place], name)


def pieces(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Texts in groups of about ``CHUNK_BYTES``; a longer text comes in pieces that overlap by a window less a byte."""
    held, size = [], 0
    for doc, sub, text in rows:
        for at in range(0, max(1, len(text) - LENGTH + 1), CHUNK_BYTES):
            part = text[at:at + CHUNK_BYTES + LENGTH - 1]
            held.append((doc, sub, at, part))
            size += len(part)
            if size >= CHUNK_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def merged(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals [low, high) of each document, sorted, with those that touch made one."""
    if not len(doc):
        return doc, low, high
    order = np.lexsort((low, doc))
    doc, low, high = doc[order], low[order], high[order]
    change = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    group = np.repeat(np.arange(len(change)), np.diff(np.concatenate((change, [len(doc)]))))
    reach = np.int64(max(1, high.max()) + 1)
    most = np.maximum.accumulate(high + group * reach) - group * reach  # the furthest end so far in the document
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (low[1:] > most[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(doc)])) - 1
    return doc[first], low[first], most[last]


#: kind 0: a run or a window to be compared; kind 1: an interval [low, low + size) known to be repeated.
ROW = "kind int, bucket long, name long, doc long, sub long, low long, size long"
FIELDS = ["kind", "bucket", "name", "doc", "sub", "low", "size"]


def _batch(kind: int, bucket, name, doc, sub, low, size) -> pa.RecordBatch:
    n = len(low)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), *(pa.array(np.asarray(c).astype(np.uint64).view(np.int64)) if np.asarray(c).dtype == np.uint64
                                                  else pa.array(np.asarray(c, np.int64)) for c in (bucket, name, doc, sub, low, size))], FIELDS)


def collapse(bucket, name, doc, sub, low, size) -> Iterator[pa.RecordBatch]:
    """Of equal names in a task the first stays to be compared; the others are repeats already.

    This bounds what a hot bucket sends on by the number of tasks, however many copies there are.
    """
    order = np.lexsort((low, sub, doc, name, bucket))
    bucket, name, doc, sub, low, size = (c[order] for c in (bucket, name, doc, sub, low, size))
    first = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (name[1:] != name[:-1])))
    owner = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    same = ~first & (doc == doc[owner]) & (sub == sub[owner]) & (low == low[owner])  # a repeated row, not a repeat
    yield _batch(0, *(c[first] for c in (bucket, name, doc, sub, low, size)))
    again = ~first & ~same
    if again.any():
        yield _known(doc[again], sub[again], low[again], low[again] + size[again] + LENGTH - 1)


def _merged(doc, sub, low, high) -> tuple[np.ndarray, ...]:
    """Merged intervals of documents that two numbers name."""
    keys, number = np.unique(np.stack((doc, sub), 1), axis=0, return_inverse=True)
    which, low, high = merged(number.ravel(), low, high)
    return keys[which, 0], keys[which, 1], low, high


def _known(doc, sub, low, high) -> pa.RecordBatch:
    """Merged intervals; they carry a name of their own, which spreads them."""
    doc, sub, low, high = _merged(doc, sub, low, high)
    spread = mixed(doc.view(np.uint64), low.astype(np.int64).view(np.uint64))
    return _batch(1, spread, spread, doc, sub, low, high - low)


class Collapser:
    """Rows of several chunks, collapsed when there are enough of them."""

    def __init__(self) -> None:
        self.held: list[tuple] = []
        self.rows = 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(columns)
        self.rows += len(columns[0])
        if self.rows >= COLLAPSE_ROWS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield from collapse(*(np.concatenate(c) for c in zip(*self.held)))
        self.held, self.rows = [], 0


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in slices(batches):
        for doc, sub, text in zip(batch.column("doc").to_pylist(), batch.column("sub").to_pylist(), batch.column("text").to_pylist()):
            yield doc, sub, text.encode("utf-8", "surrogatepass")


def _structs(lists: pa.ListArray, fields: tuple[str, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each list of structs the fields as number arrays; a null list is empty. No Python object is made per struct."""
    flat = lists.flatten()
    columns = [flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields]
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)).tolist()
    for a, b in zip([0, *ends], ends):
        yield tuple(c[a:b] for c in columns)


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = Collapser()
    for group in pieces(_texts(batches)):
        runs = runs_of([p[3] for p in group], [p[2] for p in group])
        doc, sub = np.array([p[0] for p in group], np.int64)[runs.text], np.array([p[1] for p in group], np.int64)[runs.text]
        yield from held.add(runs.bucket, runs.name, doc, sub, runs.low, runs.size)
    yield from held.rest()


def _find_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the runs that are listed with a text."""
    held = Collapser()
    for batch in slices(batches):
        runs = _structs(batch.column("runs"), ("low", "size", "bucket"))
        for (doc, sub, text), (lows, sizes_, buckets) in zip(_texts([batch]), runs):
            for at in range(0, len(lows), CHUNK_BYTES // 256):
                some = slice(at, at + CHUNK_BYTES // 256)
                sizes = sizes_[some]
                spans = [text[low:low + size + LENGTH - 1] for low, size in zip(lows[some].tolist(), sizes.tolist())]
                lengths = np.array([len(s) for s in spans])
                windows = bucket_names(np.frombuffer(b"".join(spans), np.uint8)).window
                within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                place = np.repeat(np.cumsum(lengths) - lengths, sizes) + within
                low = np.repeat(lows[some], sizes) + within
                bucket = np.repeat(buckets[some].view(np.uint64), sizes)
                n = len(low)
                yield from held.add(bucket, windows[place], np.full(n, doc, np.int64), np.full(n, sub, np.int64), low, np.ones(n, np.int64))
    yield from held.rest()


OUT = "kind int, bucket long, doc long, sub long, low long, size long"


def _compare(batches: Iterator[pa.RecordBatch], firsts: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by kind, bucket, name, document and place: what is not the first of its name is a repeat.

    Repeats come out as intervals, and if ``firsts``, the first ones of a bucket with several names as kind 0. Only the first row of the open bucket and of the open name is
    carried from batch to batch, so a bucket of any size passes.
    """
    def out(kind: int, c: dict[str, np.ndarray], rows: np.ndarray) -> pa.RecordBatch:
        n = int(rows.sum()) if rows.dtype == bool else len(rows)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(pa.array(c[f][rows]) for f in ("bucket", "doc", "sub", "low", "size"))],
                                          ["kind", "bucket", "doc", "sub", "low", "size"])

    before: dict[str, np.ndarray] | None = None  # the first row of the open bucket, and of the open name
    waiting = False  # whether the open bucket's first row has not met another name yet
    for batch in batches:
        c = {f: batch.column(f).to_numpy(zero_copy_only=False) for f in FIELDS}
        known = c["kind"] == 1
        if known.any():
            yield out(1, c, known)
            c = {f: v[~known] for f, v in c.items()}
        if not len(c["low"]):
            continue
        if before is not None:
            c = {f: np.concatenate((before[f], v)) for f, v in c.items()}
        carried = 0 if before is None else 2
        bucket, name = c["bucket"], c["name"]
        new_bucket = np.concatenate(([True], bucket[1:] != bucket[:-1]))
        new_name = new_bucket | np.concatenate(([True], name[1:] != name[:-1]))
        index = np.arange(len(bucket))
        owner = np.maximum.accumulate(np.where(new_name, index, 0))
        same = (c["doc"] == c["doc"][owner]) & (c["sub"] == c["sub"][owner]) & (c["low"] == c["low"][owner])
        fresh = index >= carried
        again = ~new_name & ~same & fresh
        if again.any():
            doc, sub, low, high = _merged(*(c[f][again] for f in ("doc", "sub", "low")), (c["low"] + c["size"] + LENGTH - 1)[again])
            spans = {"bucket": doc, "doc": doc, "sub": sub, "low": low, "size": high - low}
            yield out(1, spans, np.ones(len(doc), bool))
        later = new_name & ~new_bucket
        starts = np.flatnonzero(new_bucket)
        several = np.add.reduceat((later & fresh).astype(np.int64), starts) > 0
        wanted = later & fresh
        heads = starts[several]
        if not waiting and carried:
            heads = heads[heads >= carried]  # the carried head is out already, or stands for no run
        wanted[heads] = True
        if firsts and wanted.any():
            yield out(0, c, wanted)
        waiting = (waiting if carried and starts[-1] == 0 else True) and not several[-1]
        keep = np.array([starts[-1], owner[-1]])
        before = {f: v[keep] for f, v in c.items()}


def _compared(rows: DataFrame, firsts: bool) -> DataFrame:
    order = ["kind", "bucket", "name", "doc", "sub", "low"]
    return rows.repartition("bucket").sortWithinPartitions(*order).mapInArrow(lambda batches: _compare(batches, firsts), OUT)


def _intervals(found: DataFrame) -> DataFrame:
    return found.where("kind = 1").select("doc", "sub", "low", (F.col("low") + F.col("size")).alias("high"))


def identified(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """``row`` (a struct of the columns ``keep``), ``text``, and ``doc`` and ``sub`` by which texts are ordered and told apart.

    ``sub`` is 0 where an id stands once, else a hash of the text, so that rows repeating id and text are one document. A null
    id comes after all others.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), whole_text(text_col).alias("text"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"))
    several = rows.groupBy("doc").count().where("count > 1").select("doc", F.lit(True).alias("several"))
    if several.isEmpty():
        return rows.withColumn("sub", F.lit(0).cast("long"))
    return rows.join(several, "doc", "left").select(
        "row", "text", "doc", F.when(F.col("several"), F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("sub"))


def repeated_intervals(rows: DataFrame) -> DataFrame:
    """``doc, sub`` and the merged-by-task intervals of bytes that stand earlier, over rows of :func:`identified`."""
    texts = rows.select("doc", "sub", "text")
    runs = written(_compared(texts.where(F.octet_length("text") >= LENGTH).mapInArrow(_find_runs, ROW), True), "runs")
    listed = runs.where("kind = 0").groupBy("doc", "sub").agg(F.collect_list(F.struct("low", "size", "bucket")).alias("runs"))
    windows = texts.join(listed, ["doc", "sub"]).mapInArrow(_find_windows, ROW)
    compared = written(_compared(windows, False), "windows")
    return _intervals(runs).unionByName(_intervals(compared))


def _cut(text: bytes, low: np.ndarray, high: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of a text, how many bytes went, and in how many runs."""
    if not len(low):
        return text, 0, 0
    _, low, high = merged(np.zeros(len(low), np.int64), low, high)
    ends = np.concatenate(([0], high)).tolist()
    starts = np.concatenate((low, [len(text)])).tolist()
    return b"".join(text[a:b] for a, b in zip(ends, starts)), int((high - low).sum()), len(low)


def to_characters(text: bytes, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans moved out to the limits of UTF-8 characters, so that no two halves of characters can meet."""
    if not len(low):
        return low, high
    inside = np.append((np.frombuffer(text, np.uint8) & 0xC0) == 0x80, False)
    low, high = low.copy(), high.copy()
    for _ in range(3):
        low -= inside[low]
        high += inside[high]
    return low, high


def with_spans(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """``row`` (a struct of the columns ``keep``), ``text`` and ``spans``, the repeated intervals of the text."""
    rows = identified(docs, id_col, text_col, keep)
    spans = repeated_intervals(rows).groupBy("doc", "sub").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    return rows.join(spans, ["doc", "sub"], "left").select("row", "text", "spans")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which bytes of every whole text are covered by a string of ``LENGTH`` bytes that also starts earlier.

    Earlier is a smaller id, or the same text further in front; strings are judged on the input and never cross texts.
    Returns ``id_col, n_bytes, n_removed, n_spans`` (maximal removed runs), ``kept_sha256`` and ``kept`` (the remaining bytes).
    A null text counts as empty; texts shorter than ``LENGTH`` lose nothing. Rows that repeat id and text are one document
    and get its result each; an id with several texts orders them by a hash; a null id comes last. Other columns
    are left out. No rows give no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out = []
            spans = _structs(batch.column("spans"), ("low", "high"))
            for i, text, (low, high) in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), spans):
                raw = text.encode("utf-8", "surrogatepass")
                kept, removed, runs = _cut(raw, low, high)
                out.append((i, len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                             ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    rows = with_spans(docs, id_col, text_col, [id_col])
    rows = rows.select(F.col("row")[id_col].cast("long").alias("id"), "text", "spans")
    types = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return rows.mapInArrow(run, types).withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every text cut to the bytes that :func:`suffix_dedup` keeps, and all other columns as they are.

    A character of which only some bytes are kept goes whole. A null text becomes empty, and so does one that stands elsewhere.
    """
    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, (low, high) in zip(texts, _structs(spans, ("low", "high"))):
            raw = text.as_py().encode("utf-8", "surrogatepass")
            out.append(_cut(raw, *to_characters(raw, low, high))[0].decode("utf-8"))
        return pa.array(out, pa.string())

    rows = with_spans(docs, id_col, text_col, docs.columns)
    return rows.select(*[cut("text", "spans").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
