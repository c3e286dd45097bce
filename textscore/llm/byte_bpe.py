"""Byte-level BPE at corpus scale: each distinct word is encoded once, and ids travel back to where the word stood.

Pre-tokens are numbered within blocks of whole texts, in one pass over the texts. A block sends each of its distinct
words once, packed by word bucket, to the task of that bucket, which encodes every word it meets once; the ids go back
packed the same way and are put in place of the numbers. Words and ids cross the network once per block and not once
per occurrence, so a word that has a third of all occurrences is as cheap as a rare one. The numbers go along with the
words, in tasks of their own, so that the texts need not be read and cut a second time.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textscore.llm.common import slices, whole_text
from textscore.session import parallelism

BLOCK_BYTES = 16 << 20
MAX_BUCKETS = 1024  # pieces that the words of a block are cut into, at most
MEMO = 500_000
PLAIN_MERGE = 48
NO_RANK = 1 << 62
IDS_AT_ONCE = 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a file of the ``tiktoken`` library."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: of all neighbouring parts the pair of the lowest rank is joined, the leftmost first."""
    if word in ranks:
        return [ranks[word]]
    if len(word) <= PLAIN_MERGE:
        cuts = list(range(len(word) + 1))
        joined = [ranks.get(word[i:i + 2], NO_RANK) for i in range(len(word) - 1)]  # rank of each part with the next one
        while joined and (best := min(joined)) < NO_RANK:
            at = joined.index(best)
            del joined[at], cuts[at + 1]
            if at < len(joined):
                joined[at] = ranks.get(word[cuts[at]:cuts[at + 2]], NO_RANK)
            if at:
                joined[at - 1] = ranks.get(word[cuts[at - 1]:cuts[at + 1]], NO_RANK)
        return [ranks[word[a:b]] for a, b in zip(cuts, cuts[1:])]
    ends = list(range(1, len(word) + 1))  # end of the part that starts at each byte; 0 where a part was taken in
    before = list(range(-1, len(word) - 1))

    def rank_at(start: int) -> int | None:
        middle = ends[start]
        return ranks.get(word[start:ends[middle]]) if middle < len(word) else None

    heap = [(r, i, 1, 1) for i in range(len(word) - 1) if (r := rank_at(i)) is not None]
    heapq.heapify(heap)
    while heap:
        _, start, left, right = heapq.heappop(heap)
        middle = ends[start]
        if not middle or middle - start != left or middle >= len(word) or ends[middle] - middle != right:
            continue
        ends[start], ends[middle] = ends[middle], 0
        if ends[start] < len(word):
            before[ends[start]] = start
        for i in (start, before[start]):
            if i >= 0 and (r := rank_at(i)) is not None:
                heapq.heappush(heap, (r, i, ends[i] - i, ends[ends[i]] - ends[i]))
    out, at = [], 0
    while at < len(word):
        out.append(ranks[word[at:ends[at]]])
        at = ends[at]
    return out


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, compressed by byte planes."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class Block:
    """Distinct words of some whole texts, and their numbers in text order.

    A word's bucket is a hash of its bytes; in a bucket, words are ranked by their occurrences in the block. The
    number of a word is rank * buckets + bucket, so that common words have small numbers. While texts are added,
    a word is numbered by its first occurrence, and no occurrence is held as a string.
    """

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.size = 0
        self._content = xxhash.xxh64()
        self._seen: list[np.ndarray] = []
        self._known: dict[str, int] = defaultdict(count().__next__)

    def add(self, i: int | None, text: str, words: list[str]) -> None:
        raw = text.encode("utf-8", "surrogatepass")
        self._content.update(f"{i} {len(raw)} ")
        self._content.update(raw)
        self.size += len(raw)
        self.ids.append(i)
        self._seen.append(np.fromiter(map(self._known.__getitem__, words), "<u4", len(words)))

    @property
    def name(self) -> int:
        """A number made of the content, the same whenever a task reads the same rows."""
        return self._content.intdigest() >> 1

    @property
    def lengths(self) -> list[int]:
        return [len(numbers) for numbers in self._seen]

    def cut(self, buckets: int) -> tuple[list[list[bytes]], np.ndarray]:
        """The words of each bucket, and the numbers of all texts one after the other."""
        seen = np.concatenate([np.zeros(0, "<u4"), *self._seen])
        raw = [word.encode("utf-8", "surrogatepass") for word in self._known]
        words: list[list[bytes]] = [[] for _ in range(buckets)]
        number = np.zeros(len(raw), "<u4")
        often = np.bincount(seen, minlength=len(raw))
        for i in np.argsort(-often, kind="stable").tolist():  # of equal counts the one that comes first
            bucket = zlib.crc32(raw[i]) % buckets
            number[i] = len(words[bucket]) * buckets + bucket
            words[bucket].append(raw[i])
        return words, number[seen]


def blocks(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[Block]:
    """Blocks of about ``BLOCK_BYTES``."""
    compiled = regex.compile(pattern)
    if compiled.groups:
        raise ValueError("the pattern must match whole words and have no groups")
    block = Block()
    for batch in slices(batches, 64):
        for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            block.add(i, text, compiled.findall(text))
            if block.size >= BLOCK_BYTES:
                yield block
                block = Block()
    if block.ids:
        yield block


SENT = "block long, bucket int, task long, data binary, ids array<long>, words array<long>"
SENT_SCHEMA = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("task", pa.int64()), ("data", pa.binary()),
                         ("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int64()))])


def sent_blocks(rows: DataFrame, pattern: str, buckets: int, copies: int) -> DataFrame:
    """Distinct words of each block, a packed row for each bucket, and one row as bucket ``buckets`` with the numbers of its
    words in text order, the texts' ids and their lengths in words.

    ``task`` says which rows meet: words of a bucket in ``copies`` tasks, by their block; numbers by their block.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, pattern):
            (cut, numbers), name = block.cut(buckets), block.name
            held = [(b, words) for b, words in enumerate(cut) if words]
            data = [zstandard.compress(np.array([len(words), *map(len, words)], "<u4").tobytes() + b"".join(words), 3) for _, words in held]
            yield pa.RecordBatch.from_arrays([
                pa.array([name] * (len(held) + 1), pa.int64()), pa.array([*(b for b, _ in held), buckets], pa.int32()),
                pa.array([*(b * copies + name % copies for b, _ in held), -1 - name], pa.int64()),
                pa.array([*data, pack_numbers(numbers)], pa.binary()), pa.array([None] * len(held) + [block.ids], pa.list_(pa.int64())),
                pa.array([None] * len(held) + [block.lengths], pa.list_(pa.int64()))], schema=SENT_SCHEMA)

    return rows.mapInArrow(run, SENT)


def encoded_words(sent: DataFrame, ranks) -> DataFrame:
    """The same rows, words replaced by their ids: for each word how many, then all of them. A word is encoded once in its task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, memo = ranks.value, {}

        def packed_ids(data: bytes) -> bytes:
            data = zstandard.decompress(data)
            n = int(np.frombuffer(data, "<u4", 1)[0])
            ends = (np.cumsum(np.frombuffer(data, "<u4", n, 4)) + 4 * (n + 1)).tolist()
            at, ids, counts = 4 * (n + 1), [], []
            for end in ends:
                word = data[at:end]
                at = end
                found = memo.get(word)
                if found is None:
                    if len(memo) >= MEMO:
                        memo.clear()
                    found = memo[word] = encode_word(word, table)
                counts.append(len(found))
                ids += found
            return pack_numbers(np.array([n, *counts, *ids], "<u4"))

        for batch in slices(batches, 16):
            words = batch.column("ids").is_null().to_pylist()
            out = [packed_ids(data) if w else data for w, data in zip(words, batch.column("data").to_pylist())]
            yield batch.set_column(batch.schema.get_field_index("data"), "data", pa.array(out, pa.binary()))

    return sent.repartition("task").mapInArrow(run, SENT)


class Places:
    """Runs of numbers of unequal length, looked up by key: the ids of a word, or the bytes of a token."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> None:
        self.starts, self.lengths, self.values = starts, lengths, values

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        lengths = self.lengths[keys]
        ends = np.cumsum(lengths)
        if not len(ends):
            return self.values[:0]
        return self.values[np.repeat(self.starts[keys] - ends + lengths, lengths) + np.arange(ends[-1])]


def token_bytes(ranks: dict[bytes, int]) -> Places:
    """The token-byte table: the bytes of each id."""
    size = max(ranks.values()) + 1
    lengths = np.zeros(size, np.int64)
    by_id = {i: token for token, i in ranks.items()}
    for i, token in by_id.items():
        lengths[i] = len(token)
    values = np.frombuffer(b"".join(by_id[i] for i in sorted(by_id)), np.uint8)
    return Places(np.cumsum(lengths) - lengths, lengths, values)


def decode_ids(ids: np.ndarray, table: Places) -> bytes:
    """Bytes that ids stand for; an id that the table does not know fails."""
    if len(ids) and (int(ids.max()) >= len(table.lengths) or not table.lengths[ids].all()):
        raise ValueError("an id has no bytes in the token table")
    return table[ids].tobytes()


def _word_ids(parts: dict[int, bytes], buckets: int) -> Places:
    held = [(b, unpack_numbers(data)) for b, data in parts.items()]
    size = max((int(d[0]) * buckets for _, d in held), default=0)
    starts, lengths, values, base = np.zeros(size, np.int64), np.zeros(size, np.int64), [np.zeros(0, "<u4")], 0
    for b, d in held:
        n = int(d[0])
        counts = d[1:n + 1].astype(np.int64)
        own = slice(b, n * buckets, buckets)
        lengths[own], starts[own] = counts, base + np.cumsum(counts) - counts
        values.append(d[n + 1:])
        base += len(values[-1])
    return Places(starts, lengths, np.concatenate(values))


def corpus_bpe(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
               with_ids: bool = True) -> DataFrame:
    """Ids of every whole text as the ``tiktoken`` library would give them, and the bytes that they decode to.

    Returns ``id_col, n_tokens, ids_sha256`` (of little-endian unsigned 32-bit ids), ``decoded_sha256`` and, if ``with_ids``,
    ``token_ids`` and ``decoded``. ``path`` names the file of ranks; special tokens are text. A null text counts as empty: no ids, no bytes.
    Rows that repeat an id are encoded each; a null id stays null. Other columns are left out. No rows give no rows.

    The input is read once. Blocks are named by their content, so if a lost task is run again on rows that changed
    meanwhile, the job fails and no row gets the ids of other words. The words of a block are cut into at most
    ``MAX_BUCKETS`` pieces; where the session has more shuffle partitions than these fill, a piece has several tasks, so
    that the share of a task does not grow with the input.
    """
    spark = docs.sparkSession
    table = read_ranks(path)
    ranks = spark.sparkContext.broadcast(table)  # a vocabulary of fixed size
    decoding = spark.sparkContext.broadcast(token_bytes(table))
    wanted = 2 * parallelism(spark)
    buckets = min(MAX_BUCKETS, wanted)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    sent = encoded_words(sent_blocks(rows, pattern, buckets, -(-wanted // buckets)), ranks)
    dealt = sent.repartition("block").sortWithinPartitions("block", "bucket")  # the numbers come last, as bucket `buckets`
    fields = [("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if with_ids:
        fields += [("token_ids", pa.list_(pa.int64())), ("decoded", pa.binary())]
    schema = pa.schema(fields)

    def place(numbers: np.ndarray, known: Places, i: int | None) -> dict:
        ids_hash, bytes_hash, n, kept, decoded = hashlib.sha256(), hashlib.sha256(), 0, [], []
        for at in range(0, len(numbers), IDS_AT_ONCE):
            ids = known[numbers[at:at + IDS_AT_ONCE]]
            raw = decode_ids(ids, decoding.value)
            ids_hash.update(ids.astype("<u4").tobytes())
            bytes_hash.update(raw)
            n += len(ids)
            if with_ids:
                kept.extend(ids.tolist())
                decoded.append(raw)
        row = {"id": i, "n_tokens": n, "ids_sha256": ids_hash.hexdigest(), "decoded_sha256": bytes_hash.hexdigest()}
        return row | ({"token_ids": kept, "decoded": b"".join(decoded)} if with_ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, bytes] = {}  # of equal blocks, as repeated rows can make, the parts are equal too
        block, placed = None, True
        for batch in slices(batches, 16):
            for row in batch.to_pylist():
                if row["block"] != block:
                    if not placed:
                        raise RuntimeError("the input changed while it was read")
                    block, placed, parts = row["block"], False, {}
                if row["ids"] is None:
                    parts[row["bucket"]] = row["data"]
                    continue
                known, numbers = _word_ids(parts, buckets), unpack_numbers(row["data"])
                if len(numbers) and (int(numbers.max()) >= len(known.lengths) or not known.lengths[numbers].all()):
                    raise RuntimeError("the input changed while it was read")
                ends = np.cumsum(row["words"])
                for at in range(0, len(ends), 256):
                    each = list(zip(row["ids"], row["words"], ends))[at:at + 256]
                    yield pa.RecordBatch.from_pylist([place(numbers[end - n:end], known, i) for i, n, end in each], schema=schema)
                placed = True
        if not placed:
            raise RuntimeError("the input changed while it was read")

    types = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", token_ids array<long>, decoded binary" if with_ids else "")
    return dealt.mapInArrow(run, types).withColumnRenamed("id", id_col)
