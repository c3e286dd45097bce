"""Token vectors as one matrix, for matrices whose size was checked."""

from __future__ import annotations

import os
import pickle
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

TOKENS_AT_ONCE = 65_536
VALUES_AT_ONCE = 262_144


def token_parts(n: int) -> list[slice]:
    """Slices of a bounded number of tokens."""
    return [slice(i, i + TOKENS_AT_ONCE) for i in range(0, n, TOKENS_AT_ONCE)]


def ids_of(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch of lists, and the length of each list; a null list has none."""
    flat = lists.flatten()
    if flat.null_count:
        raise ValueError("no vector for token id NULL")
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.to_numpy(zero_copy_only=False).astype(np.int64), lengths


def parts_of(make: Callable[..., pa.Array], lists: pa.ListArray, *more: pa.Array, values: int | None = None) -> Iterator[pa.Array]:
    """``make`` of a batch, taken over a bounded number of list values (or one list) at a time: what it holds on its way stays small."""
    values = values or VALUES_AT_ONCE
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + values, side="right")))
        yield make(*(a.slice(start, stop - start) for a in (lists, *more)))
        start = stop


def by_parts(make: Callable[..., pa.Array], lists: pa.ListArray, *more: pa.Array) -> pa.Array:
    """The same as one array."""
    parts = list(parts_of(make, lists, *more))
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts) if parts else make(lists, *more)


class TokenMatrix:
    """Token vectors by id. Of rows with one id the first counts."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        rising = bool((np.diff(ids) > 0).all())
        self.rows, self.order = rows, None if rising else np.argsort(ids, kind="stable")
        self.ids = ids if rising else ids[self.order]
        self.gapless = rising and len(ids) > 0 and self.ids[-1] - self.ids[0] == len(ids) - 1

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Rows of token ids. An id without a vector fails."""
        if self.gapless:
            at = ids - self.ids[0]
            missing = np.flatnonzero((at < 0) | (at >= len(self.ids)))
        else:
            at = np.minimum(np.searchsorted(self.ids, ids), max(0, len(self.ids) - 1))
            missing = np.flatnonzero(self.ids[at] != ids) if len(self.ids) else np.arange(len(ids))
        if len(missing):
            raise ValueError(f"no vector for token id {ids[missing[0]]}")
        return at if self.order is None else self.order[at]

    def take(self, places: np.ndarray) -> np.ndarray:
        """Vectors at these rows, in double precision."""
        return self.rows[places].astype(float, copy=False)

    def sums(self, places: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """Sum of the vectors of each document; ``doc`` numbers the document of every token and never falls."""
        out = np.zeros((docs, self.rows.shape[1]))
        for part in token_parts(len(places)):
            first = np.flatnonzero(np.concatenate(([True], np.diff(doc[part]) != 0)))
            out[doc[part][first]] += np.add.reduceat(self.take(places[part]), first, axis=0)
        return out


# ---------------------------------------------------------------- in every task

def _payload_at(head: bytes, size: int) -> int:
    """Where a buffer of this size begins in the pickle that holds it alone; below 0 if it is not found."""
    at = head.find(b"\x96" + size.to_bytes(8, "little"))  # how a pickle begins a writable buffer
    return at + 9 if at >= 0 else at


#: Bytes before the rows in a file of :class:`SentMatrix`; with them the rows are aligned in the pickle, and so read several times faster.
LEAD = -_payload_at(pickle.dumps(pickle.PickleBuffer(bytearray(1 << 17)), pickle.HIGHEST_PROTOCOL)[:64], 1 << 17) % 64
MAPPED_AT_ONCE = 4
_mapped: dict[str, TokenMatrix] = {}


class SentMatrix:
    """A :class:`TokenMatrix` in every task, whose rows are mapped from the file that Spark keeps of a broadcast on each machine.

    Tasks share its pages and hold no copy of them, and neither does the driver: ``f`` is a file of ``LEAD`` bytes and the rows.
    """

    def __init__(self, spark: SparkSession, ids: np.ndarray, f: BinaryIO, dtype: np.dtype, dim: int):
        f.flush()
        self.shape, self.dtype = (len(ids), dim), np.dtype(dtype)
        self.ids = spark.sparkContext.broadcast(ids)
        self.rows = spark.sparkContext.broadcast(pickle.PickleBuffer(np.memmap(f, np.uint8, "c")))

    def _read(self, path: str | None) -> np.ndarray:
        if path and os.path.exists(path):
            with open(path, "rb") as f:
                at = _payload_at(f.read(64), LEAD + self.shape[0] * self.shape[1] * self.dtype.itemsize)
            if at >= 0 and (at + LEAD) % 64 == 0 and all(self.shape):
                return np.asarray(np.memmap(path, self.dtype, "r", at + LEAD, self.shape))
        return np.frombuffer(self.rows.value, self.dtype, offset=LEAD).reshape(self.shape).copy()

    @property
    def value(self) -> TokenMatrix:
        path = getattr(self.rows, "_path", None)
        if path is None:
            return TokenMatrix(self.ids.value, self._read(path))
        if path not in _mapped:
            if len(_mapped) >= MAPPED_AT_ONCE:
                _mapped.clear()
            _mapped[path] = TokenMatrix(self.ids.value, self._read(path))
        return _mapped[path]
