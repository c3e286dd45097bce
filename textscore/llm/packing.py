"""Packing of documents in tiers of window lengths: each tier packed, gaps of long windows filled from shorter tiers, steps balanced."""

from __future__ import annotations

import heapq
import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textscore.llm.common import slices, sorted_groups, whole_text, written

WINDOW = 2048
END_ID = 1
DOCS_IN_SHARD = 20_000
LOOSE = 16
STEP_WINDOWS = 16
#: Windows of 2048, 1024, 512 and 256 tokens.
TIERS = 4
SHARD_BITS = 32


def byte_alphabet() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones as they are, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def read_byte_bpe(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level BPE file of the ``tokenizers`` library, without its special tokens."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    letters = byte_alphabet()
    special = {t["content"] for t in data.get("added_tokens", ()) if t.get("special")}
    return {bytes(letters[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in special}


def read_added_tokens(path: str) -> list[dict]:
    """Added tokens of a file of the ``tokenizers`` library."""
    with open(path, encoding="utf-8") as file:
        return json.load(file).get("added_tokens", [])


class Encoder:
    """Ids of a byte-level BPE file; with ``added`` its added tokens are read in texts too, as the library does by default."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, added: list[dict], file: str = "") -> None:
        self.file, self.library = file, None
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added):
            raise ValueError("added tokens that look at their neighbours are not supported")
        self.coder = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.added = {t["content"]: t["id"] for t in added}
        names = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def plain(self, text: str) -> list[int]:
        """Ids of a text without added tokens.

        The pattern of the engine gives up on runs of about a million blanks, as a panic that is no ``Exception``; such a text
        goes to the library that the file belongs to.
        """
        try:
            return self.coder.encode_ordinary(text)
        except BaseException as error:
            if type(error).__name__ != "PanicException" or not self.file:
                raise
        if self.library is None:
            self.library = Tokenizer.from_str(self.file)
            self.library.encode_special_tokens = True
        return self.library.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        if not self.cut or not any(name in text for name in self.added):
            return self.plain(text)
        out: list[int] = []
        for k, part in enumerate(self.cut.split(text)):
            if k % 2:
                out.append(self.added[part])
            elif part:
                out += self.plain(part)
        return out


def atoms_of(length: int) -> list[int]:
    """Powers of two that add up to a length, the largest first."""
    return [1 << b for b in reversed(range(length.bit_length())) if length >> b & 1]


def tokenized(docs: DataFrame, id_col: str, text_col: str, path: str, pattern: str, window: int, added: bool) -> DataFrame:
    """Of every row its number of ids and checksums of the pieces it may be cut into; the ids themselves stay in the task.

    ``whole``: checksums of its full windows; ``rest``: length of what remains, ``rest_crc`` its checksum, ``atoms`` those of the
    powers of two that it may be cut into; ``salt``: a running number, which deals rows evenly.
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as file:
        text = file.read()
    sent = spark.sparkContext.broadcast((read_byte_bpe(path), read_added_tokens(path) if added else [], text))  # a vocabulary of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, names, text = sent.value
        coder = Encoder(ranks, pattern, names, text)
        count = 0
        for batch in slices(batches):
            rows = []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*coder.ids(text), END_ID], "<u4")
                full = len(ids) // window * window
                crcs = [zlib.crc32(ids[a:a + window]) for a in range(0, full, window)]
                atoms, at = [], full
                for size in atoms_of(len(ids) - full):
                    atoms.append(zlib.crc32(ids[at:at + size]))
                    at += size
                count += 1
                rows.append((i, len(ids), np.array(crcs, "<u4").tobytes(), len(ids) - full, zlib.crc32(ids[full:]),
                             np.array(atoms, "<u4").tobytes(), count))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["id", "tokens", "whole", "rest", "rest_crc", "atoms", "salt"])

    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, tokens long, whole binary, rest long, rest_crc long, atoms binary, salt long")


@dataclass
class Piece:
    """Part of the remainder of document ``doc``: where it starts in the remainder, and its checksum."""

    doc: int
    start: int
    length: int
    crc: int


class Waiting:
    """Things to be placed, by exact length."""

    def __init__(self, things: list, length) -> None:
        self.by_size: dict[int, list] = {}
        for thing in things:
            self.by_size.setdefault(length(thing), []).append(thing)
        for same in self.by_size.values():
            same.reverse()
        self.sizes = sorted(self.by_size)

    def longest(self, most: int, above: int = 0):
        """Take the longest thing of at most ``most`` and more than ``above`` tokens, the first of equals."""
        k = bisect_right(self.sizes, most)
        if not k or self.sizes[k - 1] <= above:
            return None
        same = self.by_size[self.sizes[k - 1]]
        thing = same.pop()
        if not same:
            self.sizes.pop(k - 1)
        return thing


def total(pieces: list[Piece]) -> int:
    return sum(p.length for p in pieces)


def pack_tiers(rests: list[Piece], window: int, tiers: int) -> tuple[list[list[Piece]], list[list[Piece]]]:
    """Windows that need no padding or are of full length, and full-length windows as they came out.

    A piece is routed to the shortest tier that holds it. From the longest tier on, each of its pieces opens a window of that length
    (or goes into the gap of one), and gaps take the longest pieces that fit, from this tier and the shorter ones. A short window that came out
    exactly full is a sequence; the others are units that fill long windows, longest first.
    """
    waiting = Waiting(rests, lambda p: p.length)
    done, units, long = [], [], []
    for k in range(tiers):
        tier = window >> k
        while first := waiting.longest(tier, tier // 2 if k + 1 < tiers else 0):
            pieces, gap = [first], tier - first.length
            while more := waiting.longest(gap):
                pieces.append(more)
                gap -= more.length
            filled = tier - gap
            (done if filled & (filled - 1) == 0 else long if k == 0 else units).append(pieces)
    short = Waiting(units, total)
    while first := short.longest(window):
        pieces, gap = list(first), window - total(first)
        while more := short.longest(gap):
            pieces += more
            gap -= total(more)
        long.append(pieces)
    return done, long


def pack(rests: list[Piece], atoms: list[list[int]], window: int, loose: int = LOOSE, tiers: int = TIERS) -> list[list[Piece]]:
    """Sequences of at most ``window`` tokens that leave little of their window empty.

    Tiers are packed first, see :func:`pack_tiers`. Where long windows stay open by more than ``loose`` tokens, the last of them are
    dissolved: their documents are cut into powers of two, which fill the gaps of the others. What is left of them fills
    windows exactly, the last ones shorter, and needs no padding.
    """
    sequences, long = pack_tiers(rests, window, tiers)
    long.sort(key=total, reverse=True)
    open_ = [s for s in long if window - total(s) > loose and total(s) & (total(s) - 1)]
    sequences += [s for s in long if not (window - total(s) > loose and total(s) & (total(s) - 1))]
    pool: dict[int, list[Piece]] = {}  # pieces of powers of two, by size

    def dissolve(pieces: list[Piece]) -> None:
        for piece in pieces:
            at = piece.start
            for size, crc in zip(atoms_of(piece.length), atoms[piece.doc]):
                pool.setdefault(size, []).append(Piece(piece.doc, at, size, crc))
                at += size

    while open_:
        sequence = open_.pop(0)
        gap, added = window - total(sequence), []
        while gap > loose:
            fitting = [size for size, pieces in pool.items() if pieces and size <= gap]
            if fitting:
                added.append(pool[max(fitting)].pop())
                gap -= added[-1].length
            elif open_:
                dissolve(open_.pop())
            else:
                break
        if gap > loose:
            dissolve(sequence)
            for piece in added:
                pool[piece.length].append(piece)
        else:
            sequences.append(sequence + added)
    cut = [piece for pieces in pool.values() for piece in pieces]
    cut.sort(key=lambda p: (-p.length, p.doc, p.start))
    left = sum(p.length for p in cut)
    sequence, room = [], 0
    for piece in cut:  # sizes fall, so windows of the largest power of two left are filled exactly
        if not room:
            room = min(window, 1 << (left.bit_length() - 1))
            sequence = []
            sequences.append(sequence)
        sequence.append(piece)
        room -= piece.length
        left -= piece.length
    return sequences


def balanced_steps(lengths: list[int], window: int) -> list[int]:
    """Step of each sequence, such that steps hold nearly equal numbers of tokens: the longest go first, each to the lightest step."""
    steps = max(1, -(-sum(lengths) // (STEP_WINDOWS * window)))
    heap = [(0, s) for s in range(steps)]
    out = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        tokens, step = heapq.heappop(heap)
        out[i] = step
        heapq.heappush(heap, (tokens + lengths[i], step))
    return out


RESULT = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "tier long, step_id long")


def _shards(window: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard in sorted_groups(frames, ["shard"]):
            shard = shard.sort_values(["nameless", "id", "tokens", "salt"], kind="stable").reset_index(drop=True)
            rest = shard["rest"].to_numpy()
            full = shard["tokens"].to_numpy() - rest
            atoms = [np.frombuffer(a, "<u4").tolist() for a in shard["atoms"]]
            sequences = [[Piece(d, a * window, window, int(c))] for d, crcs in enumerate(shard["whole"])
                         for a, c in enumerate(np.frombuffer(crcs, "<u4"))]
            rests = [Piece(d, int(full[d]), int(rest[d]), int(shard["rest_crc"].iat[d])) for d in np.flatnonzero(rest)]
            sequences += pack(rests, atoms, window)
            lengths = [total(s) for s in sequences]
            steps = balanced_steps(lengths, window)
            first = int(shard["shard"].iat[0]) << SHARD_BITS
            rows = []
            for i, sequence in enumerate(sequences):
                tier = lengths[i] if lengths[i] & (lengths[i] - 1) == 0 else window
                at = 0
                for p in sequence:
                    rows.append((p.doc, p.start, p.length, p.crc, first + i, at, tier, first + steps[i]))
                    at += p.length
            out = pd.DataFrame(rows, columns=["doc", "start", "length", "ids_crc32", "sequence_id", "offset", "tier", "step_id"])
            doc = out["doc"].to_numpy()
            out["doc_id"] = pd.arrays.IntegerArray(shard["id"].to_numpy()[doc], shard["nameless"].to_numpy()[doc])
            out["doc_tokens"] = shard["tokens"].to_numpy()[out.pop("doc")]
            yield out

    return run


def pack_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, added: bool = False) -> DataFrame:
    """Every id of every row in exactly one piece of a sequence of at most ``window`` ids.

    Returns ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and ``tier`` (length that the sequence is padded
    to) and ``step_id`` (group of sequences of nearly equal tokens). Ids are those of the ``tokenizers`` file at ``path`` and an end id
    for each row; added tokens that stand in a text are read as text, or with ``added`` as their ids, as the library does by default. A document's full windows are sequences of their own; remainders, one
    per document, are dealt evenly into shards of bounded size and packed there, so a task holds one shard. A null text
    counts as empty and has the end id only. Rows that repeat an id are documents of their own; a null id stays
    null. Other columns are left out. No rows give no rows.
    """
    rows = written(tokenized(docs, id_col, text_col, path, pattern, window, added), "tokenized")
    shards = max(1, -(-rows.count() // DOCS_IN_SHARD))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "salt", "rest_crc"), F.lit(shards)))
    # A null among ids would make pandas hold them as floating numbers, which change large ones.
    dealt = dealt.withColumns({"nameless": F.col("id").isNull(), "id": F.coalesce("id", F.lit(0).cast("long"))})
    dealt = dealt.repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInPandas(_shards(window), RESULT).withColumnRenamed("doc_id", id_col)
