"""Vocabulary training on a table of distinct words, by rounds that decide many merges each.

A word is a string with one code point per symbol: characters stand for themselves, merged symbols take code points
above all of them. A merge is a plain ``replace``, and the order of pair strings is the order of their symbol ids,
which is how ties are broken.
"""

from __future__ import annotations

import heapq
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textscore.session import delete_path, parallelism, scratch_path

# The helpers below travel with the task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FIRST_MERGE_SYMBOL = 0xF0000
#: Stands for the end of a word beside a run; never a symbol.
EDGE = chr(sys.maxunicode)
FIRST_PAIRS = 8
MAX_RUNS = 400_000
MAX_PAIRS = 1_000_000
WORDS_PER_PART = 250_000
MAX_GENERATIONS = 2
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
RUNS_PER_TASK = 200_000


def pairs_of(s: Column) -> Column:
    """Neighbours in a word: its two-symbol blocks from the first symbol on and those from the second symbol on."""
    two = F.lit("(?s)..")
    return F.concat(F.regexp_extract_all(s, two, F.lit(0)),
                    F.regexp_extract_all(F.substring(s, F.lit(2), F.length(s)), two, F.lit(0)))


@dataclass
class Symbols:
    """The growing vocabulary: tokens in id order, merged pairs in rank order, and the code point of each symbol."""

    tokens: list[str]
    alphabet: list[str]
    merges: list[tuple[str, str]] = field(default_factory=list)

    def __post_init__(self):
        self.text_of = {ch: ch for ch in self.alphabet}
        self.symbol_of = dict(self.text_of)
        self.known = set(self.tokens)
        self.next = max(FIRST_MERGE_SYMBOL, ord(max(self.alphabet)) + 1 if self.alphabet else 0)

    def room(self) -> int:
        """Code points left for merged symbols."""
        return max(0, ord(EDGE) - self.next)

    def merge(self, pair: str) -> tuple[str, bool]:
        """Take the pair as the next rule. Gives its symbol and whether that is a new one; two pairs may spell one token."""
        left, right = (self.text_of[c] for c in pair)
        text = left + right
        new = text not in self.symbol_of
        if new:
            symbol = chr(self.next)
            self.symbol_of[text], self.text_of[symbol] = symbol, text
            self.next += 1
        if text not in self.known:
            self.known.add(text)
            self.tokens.append(text)
        self.merges.append((left, right))
        return self.symbol_of[text], new


class PairTotals:
    """How often each pair stands in the corpus: counted once, then changed by what merges do.

    Pairs that are not held have at most ``floor`` occurrences.
    """

    def __init__(self, totals: dict[str, int], floor: int):
        self.totals, self.floor = totals, floor
        self.queue = [(-n, pair) for pair, n in totals.items()]
        heapq.heapify(self.queue)

    def best(self) -> str | None:
        """The most frequent pair, the one with the smallest symbol ids among equals."""
        while self.queue:
            n, pair = self.queue[0]
            if n < 0 and self.totals.get(pair, 0) == -n:
                return pair
            heapq.heappop(self.queue)
        return None

    def top(self, most: int) -> list[str]:
        return [pair for n, pair in heapq.nsmallest(most, ((-n, pair) for pair, n in self.totals.items() if n > 0))]

    def change(self, changes: dict[str, int], fresh: set[str]) -> None:
        for pair, n in changes.items():
            if n and (pair in self.totals or not self.floor or pair[0] in fresh or pair[1] in fresh):
                total = self.totals[pair] = self.totals.get(pair, 0) + n
                if total > 0:
                    heapq.heappush(self.queue, (-total, pair))
                else:
                    del self.totals[pair]


# ---------------------------------------------------------------- the words

class Words:
    """The distinct words as a table, and the merges that it does not hold yet.

    A round is one map over the table that applies these merges on the way; nothing is shuffled but the runs. The table is written
    anew after ``MAX_GENERATIONS`` rounds, without the words that are one symbol by then, and the old one is deleted.
    """

    SCHEMA = "s string, n long"

    def __init__(self, words: DataFrame):
        self.spark: SparkSession = words.sparkSession
        words = words.where(F.length("s") >= 2).select("s", "n")
        self.parts = max(parallelism(self.spark), 1 + words.count() // WORDS_PER_PART)
        self.path, self.pending, self.rounds = None, [], 0
        self._write(words.repartition(self.parts))

    def _write(self, words: DataFrame) -> None:
        before, self.path = self.path, scratch_path(self.spark, "bpe-index")
        words.write.parquet(self.path)
        self.pending, self.rounds = [], 0
        if before:
            delete_path(self.spark, before)

    def stored(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def now(self) -> DataFrame:
        return self.stored().mapInArrow(_merged(self.pending), self.SCHEMA) if self.pending else self.stored()

    def runs(self, pairs: list[str]) -> DataFrame:
        return self.stored().mapInArrow(_runs_of(pairs, self.pending), "run string, n long").groupBy("run").agg(F.sum("n").alias("n"))

    def holding(self, pairs: list[str]) -> DataFrame:
        """Words that hold any of the pairs, as they are now."""
        return self.now().mapInArrow(_holding(pairs), self.SCHEMA)

    def merge(self, merged: list[tuple[str, str]]) -> None:
        self.pending, self.rounds = [*self.pending, *merged], self.rounds + 1
        if self.rounds >= MAX_GENERATIONS:
            self._write(self.now())

    def totals(self) -> PairTotals:
        """Count all pairs of the words as they are now."""
        counted = self.now().select("n", F.explode(pairs_of(F.col("s"))).alias("pair")).groupBy("pair").agg(F.sum("n").alias("total"))
        rows = counted.orderBy(F.desc("total"), "pair").limit(MAX_PAIRS + 1).collect()
        floor = rows[-1]["total"] if len(rows) > MAX_PAIRS else 0
        return PairTotals({r["pair"]: r["total"] for r in rows[:MAX_PAIRS]}, floor)

    def drop(self) -> None:
        delete_path(self.spark, self.path)


# ---------------------------------------------------------------- runs

class Pairs:
    """Pairs as sorted numbers, with the symbols that are first and last in one."""

    def __init__(self, pairs: list[str]):
        self.keys = np.array(sorted((ord(a) << 21) + ord(b) for a, b in pairs), np.int64)
        self.left, self.right = np.zeros(sys.maxunicode + 1, bool), np.zeros(sys.maxunicode + 1, bool)
        self.left[self.keys >> 21] = self.right[self.keys & 0x1FFFFF] = True


class Hits:
    """Where any of some pairs, at least one, stand in a batch of words, which are held as one string."""

    def __init__(self, words: str, pairs: Pairs):
        self.joined = EDGE + words + EDGE
        self.codes = np.frombuffer(self.joined.encode("utf-32-le"), "<u4")
        self.hit = np.zeros(len(self.codes) - 1, bool)
        some = np.flatnonzero(pairs.left[self.codes[:-1]] & pairs.right[self.codes[1:]])
        keys = (self.codes[some].astype(np.int64) << 21) + self.codes[some + 1]
        self.hit[some] = pairs.keys[np.minimum(np.searchsorted(pairs.keys, keys), len(pairs.keys) - 1)] == keys

    def word(self, at: np.ndarray) -> np.ndarray:
        """The number of the word at each place."""
        return np.searchsorted(np.flatnonzero(self.codes == ord(EDGE)), at, side="right") - 1

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of symbols that stand in any of the pairs."""
        active = np.zeros(len(self.hit) + 2, bool)
        active[:-2] |= self.hit
        active[1:-1] |= self.hit
        edges = np.flatnonzero(np.diff(active.astype(np.int8)))
        return edges[::2] + 1, edges[1::2] + 1


def _joined(batch: pa.RecordBatch, merges: list[tuple[str, str]]) -> str:
    """The words of a batch as one string after the merges; a merge is one pass over it."""
    joined = EDGE.join(batch.column("s").to_pylist())
    for pair, symbol in merges:
        joined = joined.replace(pair, symbol)
    return joined


def _holding(pairs: list[str]):
    """Words that hold any of the pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Pairs(pairs)
        for batch in batches:
            hits = Hits(_joined(batch, []), wanted)
            yield batch.take(pa.array(np.unique(hits.word(np.flatnonzero(hits.hit)))))

    return run


def _slices(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The symbols from each start up to its end, as strings."""
    sizes = ends - starts
    heads = np.cumsum(sizes) - sizes
    taken = codes[np.repeat(starts - heads, sizes) + np.arange(sizes.sum())]
    data = taken.tobytes().decode("utf-32-le").encode()
    width = 1 + (taken > 0x7F) + (taken > 0x7FF) + (taken > 0xFFFF)
    at = np.concatenate(([0], np.cumsum(width)))[np.append(heads, len(taken))]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))


def _runs_of(pairs: list[str], merges: list[tuple[str, str]]):
    """Runs of symbols that stand in any of the pairs, with the symbol on either side, and how often each occurs.

    What the pairs' merges do depends on these runs only: symbols beside a run stay as they are. ``merges`` are applied first.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, found, held = Pairs(pairs), [], 0

        def summed() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(found).group_by("run").aggregate([("n", "sum")])
            yield from table.rename_columns({"run": "run", "n_sum": "n"}).select(["run", "n"]).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            hits = Hits(_joined(batch, merges), wanted)
            starts, ends = hits.runs()
            n = batch.column("n").to_numpy(zero_copy_only=False)[hits.word(starts)]
            found.append(pa.RecordBatch.from_arrays([_slices(hits.codes, starts - 1, ends + 1), pa.array(n, pa.int64())], ["run", "n"]))
            held += len(starts)
            if held > RUNS_PER_TASK:
                yield from summed()
                found, held = [], 0
        if found:
            yield from summed()

    return run


def runs(words: Words, pairs: list[str]) -> pa.Table | None:
    """The distinct runs and their counts, or nothing if there are more than ``MAX_RUNS``.

    Runs of a single pair are always given: they are few, as they differ by the symbols on either side only.
    """
    found = words.runs(pairs)
    table = (found.limit(MAX_RUNS + 1) if len(pairs) > 1 else found).toArrow()
    return None if len(table) > MAX_RUNS and len(pairs) > 1 else table


def _pair(key: int) -> str:
    return chr(key >> 21) + chr(key & 0x1FFFFF)


class Runs:
    """Runs as linked symbols in arrays, with the places of each pair that lies inside one; a merge touches its own places only."""

    def __init__(self, texts: list[str], times: list[int]):
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
        self.times = np.repeat(np.array(times, np.int64), sizes)
        self.after, self.before = np.arange(1, len(self.codes) + 1), np.arange(-1, len(self.codes) - 1)
        self.side = np.zeros(len(self.codes), bool)
        self.side[ends - sizes] = self.side[ends - 1] = True
        starts = np.ones(len(self.codes), bool)
        starts[ends - 1] = False
        self.marked = np.zeros(len(self.codes), bool)
        self.places: dict[int, list[np.ndarray]] = {}
        pairs = np.flatnonzero(starts)
        at_side = self._at_side(pairs)
        self.outside = Counter({_pair(key): n for key, n, _ in self._by_pair(pairs[at_side])})
        for key, _, places in self._by_pair(pairs[~at_side]):
            self.places[key] = [places]

    def _at_side(self, at: np.ndarray) -> np.ndarray:
        return self.side[at] | self.side[self.after[at]]

    def _by_pair(self, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """The pairs that begin at some places: how often each occurs, and where."""
        if not len(at):
            return
        keys = (self.codes[at] << 21) + self.codes[self.after[at]]
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        ends = [*first[1:].tolist(), len(at)]
        times = np.add.reduceat(self.times[at], first)
        for key, n, begin, end in zip(keys[first].tolist(), times.tolist(), first.tolist(), ends):
            yield key, n, at[begin:end]

    def _without(self, at: np.ndarray, some: np.ndarray) -> np.ndarray:
        """The places ``at`` that are not among ``some``."""
        self.marked[some] = True
        left = at[~self.marked[at]]
        self.marked[some] = False
        return left

    def _found(self, key: int) -> np.ndarray:
        """Where the pair stands now, leftmost first and without overlap."""
        at = np.sort(np.concatenate([np.zeros(0, np.int64), *self.places.pop(key, [])]))
        at = at[np.diff(at, prepend=-1) > 0]
        at = at[self.codes[at] == key >> 21]
        at = at[self.codes[self.after[at]] == key & 0x1FFFFF]
        if key >> 21 == key & 0x1FFFFF and len(at):
            first = np.concatenate(([True], at[1:] != self.after[at[:-1]]))
            number = np.arange(len(at))
            at = at[(number - np.maximum.accumulate(np.where(first, number, 0))) % 2 == 0]
        return at

    def merge(self, pair: str, symbol: str) -> dict[str, int]:
        """Put the symbol in place of the pair inside all runs; gives by how much the totals of pairs change."""
        at = self._found((ord(pair[0]) << 21) + ord(pair[1]))
        second = self.after[at]
        changes: Counter = Counter()

        def count(where: np.ndarray, sign: int, new: bool) -> None:
            at_side = self._at_side(where)
            for side in (False, True):
                for key, n, places in self._by_pair(where[at_side == side]):
                    changes[_pair(key)] += sign * n
                    if side:
                        self.outside[_pair(key)] += sign * n
                    elif new:
                        self.places.setdefault(key, []).append(places)

        count(np.concatenate((self._without(self.before[at], second), at, second)), -1, False)
        self.codes[at], self.codes[second] = ord(symbol), -1
        self.after[at] = self.after[second]
        self.before[self.after[second]] = at
        count(np.concatenate((self._without(self.before[at], at), at)), 1, True)
        return {p: n for p, n in changes.items() if EDGE not in p}


def merge_runs(found: pa.Table, chosen: list[str], totals: PairTotals, symbols: Symbols, vocab_size: int):
    """Merge the best pair again and again, as long as all its occurrences lie inside the runs.

    That holds for a chosen pair and for one with a symbol that these merges made, unless it also stands at the side of a
    run. Totals are changed by the exact differences, so the order of merges is that of a full recount after each.
    Gives ``[(pair, symbol)]`` and whether pairs that are not held may have become more frequent, as when a second pair
    spells an old token.
    """
    held = Runs(found["run"].to_pylist(), found["n"].to_pylist())
    chosen, fresh, done = set(chosen), set(), []
    while len(symbols.tokens) < vocab_size:
        pair = totals.best()
        if pair is None or held.outside[pair] or done and totals.totals[pair] <= totals.floor:
            break
        if pair not in chosen and pair[0] not in fresh and pair[1] not in fresh:
            break
        symbol, new = symbols.merge(pair)
        if new:
            fresh.add(symbol)
        done.append((pair, symbol))
        totals.change(held.merge(pair, symbol), fresh)
        if totals.floor and not new:
            return done, True
    return done, False


def _merged(merges: list[tuple[str, str]]):
    """The words after the merges, without those that are one symbol then."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array(_joined(batch, merges).split(EDGE) if batch.num_rows else [], pa.string())
            out = pa.RecordBatch.from_arrays([new, batch.column("n")], ["s", "n"])
            yield out.filter(pc.greater(pc.utf8_length(new), 1))

    return run


def train(words: DataFrame, symbols: Symbols, vocab_size: int, progress: list | None = None) -> None:
    """:func:`_train`, with shuffle files deleted as soon as a job has ended: rounds make many and read none again."""
    conf = words.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        _train(words, symbols, vocab_size, progress)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)


def _train(words: DataFrame, symbols: Symbols, vocab_size: int, progress: list | None) -> None:
    """Grow the vocabulary to ``vocab_size`` tokens from ``words`` (``s``, ``n``).

    A round counts the runs of the most frequent pairs in one map over the words, and fetches those, a bounded number; the
    number of pairs follows from it. All merges that can be decided from the runs are taken; they are applied to the words on the
    way, and the words are written anew after some rounds. The driver holds vocabulary, pair totals (up to ``MAX_PAIRS``) and
    one round's runs. ``progress`` receives ``(merges so far, words that hold one of the pairs, words changed)`` of each round,
    which costs two more passes.
    """
    table = Words(words)
    totals, wanted, counted = table.totals(), FIRST_PAIRS, True
    stale = False
    while len(symbols.tokens) < vocab_size:
        best = totals.best()
        low = totals.floor and (best is None or totals.totals[best] <= totals.floor)
        if not counted and (stale or low):
            totals, counted = table.totals(), True
            best = totals.best()
        if best is None:
            break
        pairs = totals.top(wanted)
        while (found := runs(table, pairs)) is None:
            pairs = pairs[:len(pairs) // 2]
        wanted = len(pairs) * (4 if len(found) < MAX_RUNS // 8 else 2 if len(found) < MAX_RUNS // 3 else 1)
        merged, stale = merge_runs(found, pairs, totals, symbols, vocab_size)
        if progress is not None:
            taken = [pair for pair, _ in merged if pair in set(pairs)]
            progress.append((len(symbols.merges), table.holding(pairs).count(), table.holding(taken).count() if taken else 0))
        if len(symbols.tokens) < vocab_size:
            table.merge(merged)
        counted = False
    table.drop()
