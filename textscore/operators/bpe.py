"""Byte-pair vocabularies: training and encoding as Spark jobs."""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textscore.functions.text import PADDING_TOKEN, pretokens
from textscore.operators.matrix import parts_of
from textscore.operators.pair_index import Symbols, train
from textscore.operators.tokens import special_rows, word_counts
from textscore.session import delete_path, scratch_path

# The helpers below travel with the task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CACHED_WORDS = 200_000
MAX_VOCABULARY = 2_000_000


# ---------------------------------------------------------------- training

def bpe_train(
    df: DataFrame, x: str, vocab_size: int = 1000, special: Sequence[str] = (PADDING_TOKEN,),
    lowercase: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Vocabulary ``(token, id)`` and merges ``(rank, left, right)``."""
    spark = df.sparkSession
    tokens, merges = merge_rules(word_counts(df, x, lowercase), vocab_size, special)
    vocab = spark.createDataFrame(list(zip(tokens, range(len(tokens)))), "token string, id int")
    rules = [(i, left, right) for i, (left, right) in enumerate(merges)]
    return vocab, spark.createDataFrame(rules, "rank int, left string, right string")


def merge_rules(words: DataFrame, vocab_size: int, special: Sequence[str], progress: list | None = None):
    """Tokens in id order and merged pairs in rank order, from a table of distinct words and their counts.

    The text is read once, for that table; :func:`textscore.operators.pair_index.train` does the rest.
    """
    table = words.select(F.col("word").alias("s"), "n")
    path = scratch_path(words.sparkSession, "bpe-words")
    table.write.parquet(path)
    table = words.sparkSession.read.schema(table.schema).parquet(path)
    alphabet = sorted(r[0] for r in table.select(F.explode(F.array_distinct(F.split("s", "")))).distinct().collect())
    fixed = [t for t, _ in special_rows(special)]
    symbols = Symbols(fixed + [ch for ch in alphabet if ch not in set(fixed)], alphabet)
    wanted = vocab_size - len(symbols.tokens)
    if wanted > symbols.room():
        raise ValueError(f"vocabulary of {vocab_size} needs {wanted} symbols above the alphabet, {symbols.room()} are free")
    if wanted > 0:
        train(table, symbols, vocab_size, progress)
    delete_path(words.sparkSession, path)
    return symbols.tokens, symbols.merges


# ---------------------------------------------------------------- encoding

def merge_word(symbols: list[int], rules: dict[tuple[int, int], tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Merge the neighbours of lowest rank first, leftmost first.

    Returns ``(id, first symbol, end symbol)`` per piece.
    """
    n = len(symbols)
    ids, ends, after, before = list(symbols), list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    queue = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (ids[i], ids[j]) in rules:
            rank, new = rules[ids[i], ids[j]]
            heapq.heappush(queue, (rank, i, j, ids[i], ids[j], new))

    for i in range(n - 1):
        offer(i)
    while queue:
        _, i, j, a, b, new = heapq.heappop(queue)
        if ids[i] != a or after[i] != j or ids[j] != b:
            continue
        ids[i], ids[j], ends[i], after[i] = new, -1, ends[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    pieces, i = [], 0
    while i < n:
        pieces.append((ids[i], i, ends[i]))
        i = after[i]
    return pieces


class PieceTable:
    """Pieces of distinct words, filled as words turn up in a task."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: set[str], lowercase: bool):
        self.vocab, self.special, self.lowercase = vocab, special, lowercase
        self.tokens = {i: t for t, i in vocab.items()}
        self.rules = {}
        for rank, (a, b) in enumerate(merges):
            self.rules.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.names = pa.array([self.tokens[i] for i in range(len(self.tokens))], pa.string())
        self.cache: dict[str, bytes] = {}

    def pieces(self, word: str) -> bytes:
        """``id, start, end`` of each piece inside the word, as 32-bit numbers; characters out of the alphabet drop out."""
        found = self.cache.get(word)
        if found is None:
            if word.isspace():
                found = []
            elif word in self.special:
                found = [(self.vocab[word], 0, len(word))]
            else:
                symbols, origin = [], []
                for i, ch in enumerate(word):
                    for low in ch.lower() if self.lowercase else ch:
                        if low in self.vocab:
                            symbols.append(self.vocab[low])
                            origin.append(i)
                found = [(t, origin[a], origin[b - 1] + 1) for t, a, b in merge_word(symbols, self.rules)]
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            found = self.cache[word] = np.array(found, np.int32).tobytes()
        return found


def _encode_lists(words: pa.ListArray, table: PieceTable, offsets: bool) -> pa.StructArray:
    """Encode a batch of word lists: each distinct word once, then gather."""
    first = words.offsets.to_numpy()
    flat = words.values.slice(first[0], first[-1] - first[0]).dictionary_encode()
    which = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = flat.dictionary.to_pylist()
    pieces = [table.pieces(w) for w in distinct]
    sizes = np.array([len(p) // 12 for p in pieces], dtype=np.int64)
    heads = np.concatenate([[0], np.cumsum(sizes)])
    rows = np.frombuffer(b"".join(pieces), np.int32).reshape(-1, 3)

    counts = sizes[which]
    ends = np.concatenate([[0], np.cumsum(counts)])
    within = np.arange(ends[-1]) - np.repeat(ends[:-1], counts)
    taken = rows[np.repeat(heads[which], counts) + within]
    per_text = pa.array(ends[first - first[0]], pa.int32())
    ids = pa.array(taken[:, 0], pa.int32())
    out = {
        "ids": pa.ListArray.from_arrays(per_text, ids),
        "tokens": pa.ListArray.from_arrays(per_text, table.names.take(ids)),
    }
    if offsets:
        lengths = np.array([len(w) for w in distinct], dtype=np.int64)[which]
        ahead = np.concatenate([[0], np.cumsum(lengths)])
        text_of_word = np.repeat(np.arange(len(first) - 1), np.diff(first))
        start = ahead[:-1] - ahead[first[:-1] - first[0]][text_of_word]
        base = np.repeat(start, counts)
        spans = pa.StructArray.from_arrays(
            [pa.array(base + taken[:, k], pa.int32()) for k in (1, 2)], ["start", "end"]
        )
        out["offsets"] = pa.ListArray.from_arrays(per_text, spans)
    return pa.StructArray.from_arrays(list(out.values()), list(out))


def encode_text(
    df: DataFrame, x: str, vocab: DataFrame, merges: DataFrame,
    special: Sequence[str] = (PADDING_TOKEN,), lowercase: bool = True, offsets: bool = True,
) -> DataFrame:
    """Add ``ids``, ``tokens`` and ``offsets`` (positions in the original text).

    Special tokens are cut out first, then words and punctuation runs; this
    is done by one JVM expression. The word lists go to Python as Arrow lists,
    where each distinct word of a batch is merged once. The job is a single
    map over the table: nothing is shuffled, so no frequent word and no long
    text can overload a task. Only the vocabulary travels to the executors.
    """
    spark = df.sparkSession
    size = vocab.count()
    if size > MAX_VOCABULARY:
        raise ValueError(f"vocabulary of {size} tokens is too large to send to every task")
    rows = vocab.collect()
    shipped = spark.sparkContext.broadcast((
        {r["token"]: r["id"] for r in rows},
        [(r["left"], r["right"]) for r in merges.orderBy("rank").collect()],
        set(special), lowercase,
    ))
    kind = "struct<ids:array<int>,tokens:array<string>{}>".format(
        ",offsets:array<struct<start:int,end:int>>" if offsets else ""
    )

    @F.arrow_udf(kind)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = PieceTable(*shipped.value)
        for words in batches:
            yield from parts_of(lambda part: _encode_lists(part, table, offsets), words)

    words = pretokens(F.coalesce(F.col(x), F.lit("")), special, gaps=True)
    encoded = df.withColumn("_encoded", encode(words))
    fields = ["ids", "tokens"] + (["offsets"] if offsets else [])
    return encoded.select(*df.columns, *[F.col(f"_encoded.{f}").alias(f) for f in fields])
