"""Pretokens, word tables and fixed-length id sequences."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textscore.functions.text import BLANK, PADDING_ID, PADDING_TOKEN, lower_by_char, pretokens
from textscore.operators.matrix import by_parts

# The helpers below travel with the task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def normalize_lower(df: DataFrame, x: str) -> DataFrame:
    return df.withColumn(x, lower_by_char(F.col(x)))


def _words(x: Column, lowercase: bool) -> Column:
    return pretokens(lower_by_char(x) if lowercase else x)


def pretokenize(df: DataFrame, x: str, lowercase: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """One row per word or punctuation run, with its position in the text."""
    return df.select(*keep, F.posexplode(_words(F.col(x), lowercase)).alias("pos", "word"))


def pretoken_offsets(df: DataFrame, id: str, x: str, lowercase: bool = True) -> DataFrame:
    """One row per pretoken with its place ``start`` to ``end`` in the original text."""
    spans = F.arrow_udf(lambda pieces: by_parts(lambda part: _spans_of(part, True), pieces), "array<struct<word:string,start:int,end:int>>")
    rows = df.select(id, F.posexplode(spans(pretokens(F.coalesce(F.col(x), F.lit("")), gaps=True))).alias("pos", "_s"))
    piece = F.col("_s.word")
    return rows.select(id, "pos", (lower_by_char(piece) if lowercase else piece).alias("word"), "_s.start", "_s.end")


def _spans_of(pieces: pa.Array, named: bool = False) -> pa.Array:
    """Places of the words among pieces that cover a text: sums of the lengths before them. With the words, if ``named``."""
    counts = pieces.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pieces.flatten()
    lengths = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    first = np.cumsum(counts) - counts
    base = np.repeat(np.concatenate(([0], ends))[first], counts)
    is_word = ~pc.match_substring_regex(flat, "^" + BLANK).to_numpy(zero_copy_only=False).astype(bool)
    doc = np.repeat(np.arange(len(counts)), counts)[is_word]
    places = [pa.array((ends - lengths - base)[is_word], pa.int32()), pa.array((ends - base)[is_word], pa.int32())]
    words = [flat.filter(pa.array(is_word))] if named else []
    spans = pa.StructArray.from_arrays([*words, *places], [*["word"] * named, "start", "end"])
    per_text = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(counts)))))
    return pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), spans)


def pretoken_spans(df: DataFrame, x: str, out: str = "offsets") -> DataFrame:
    """Add the places of all pretokens of a text as one array. Nothing leaves the row."""
    spans = F.arrow_udf(lambda pieces: by_parts(_spans_of, pieces), "array<struct<start:int,end:int>>")
    return df.withColumn(out, spans(pretokens(F.coalesce(F.col(x), F.lit("")), gaps=True)))


def word_lists(df: DataFrame, x: str, lowercase: bool = True, out: str = "words") -> DataFrame:
    return df.withColumn(out, _words(F.col(x), lowercase))


def hashed_ids(df: DataFrame, words: str, size: int, out: str = "ids") -> DataFrame:
    """Add an id below ``size`` for each word: the first 32 bits of its md5, modulo ``size``. Each distinct word of a batch is hashed once."""
    def ids_of_batch(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().dictionary_encode()
        each = [int.from_bytes(md5(w).digest()[:4], "big") % size for w in flat.dictionary.cast(pa.binary()).to_pylist()]
        ends = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
        return pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), pa.array(each, pa.int32()).take(flat.indices), mask=lists.is_null() if lists.null_count else None)

    return df.withColumn(out, F.arrow_udf(ids_of_batch, "array<int>")(F.col(words)))


def corpus_text_iter(df: DataFrame, x: str) -> DataFrame:
    """The texts of a corpus as the source for a vocabulary."""
    return df.select(x).where(F.col(x).isNotNull())


def word_counts(df: DataFrame, x: str, lowercase: bool = True) -> DataFrame:
    """Frequency of each pretoken. Frequent words combine before the shuffle."""
    return (
        df.select(F.explode(_words(F.col(x), lowercase)).alias("word"))
        .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    )


def special_rows(special: Sequence[str]) -> list[tuple[str, int]]:
    return [(t, i) for i, t in enumerate(dict.fromkeys(special))]


def alphabet(words: DataFrame, special: Sequence[str] = (PADDING_TOKEN,)) -> DataFrame:
    """Specials with the first ids, then the characters in code-point order.

    The characters are made distinct before they are numbered, so the one
    sort is over the alphabet, not over text.
    """
    spark = words.sparkSession
    fixed = special_rows(special)
    chars = (
        words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("token"))
        .distinct()
        .where(~F.col("token").isin([t for t, _ in fixed] or [""]))
    )
    numbered = chars.select(
        "token", (F.row_number().over(Window.orderBy("token")) + len(fixed) - 1).cast("int").alias("id")
    )
    return spark.createDataFrame(fixed, "token string, id int").unionByName(numbered)


def special_tokens(vocab: DataFrame, special: Sequence[str]) -> DataFrame:
    """The leading rows of a vocabulary that hold its special tokens."""
    return vocab.where(F.col("token").isin(*special))


def vocab_size(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.count(F.lit(1)).alias("vocab_size"))


def adjacent_pairs(symbols: Column) -> Column:
    """``(left, right)`` of each two neighbours of an array."""
    n = F.size(symbols) - 1
    return F.zip_with(
        F.slice(symbols, F.lit(1), n), F.slice(symbols, F.lit(2), n),
        lambda a, b: F.struct(a.alias("left"), b.alias("right")),
    )


def pair_counts(words: DataFrame) -> DataFrame:
    """Adjacent character pairs weighted by the frequency of their word."""
    symbols = F.split("word", "")
    return (
        words.where(F.length("word") >= 2)
        .select("n", F.inline(adjacent_pairs(symbols)))
        .groupBy("left", "right").agg(F.sum("n").alias("n"))
    )


def pad_truncate(df: DataFrame, ids: str, length: int | str, out: str | None = None) -> DataFrame:
    """Cut longer and pad shorter sequences to ``length``.

    ``length`` may be ``"max"``: the longest sequence of the table, found by
    one aggregate.
    """
    if length == "max":
        length = df.agg(F.max(F.size(ids))).first()[0] or 0
    padded = F.concat(F.col(ids), F.array_repeat(
        F.lit(PADDING_ID).cast("int"), F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    ))
    return df.withColumn(out or ids, F.slice(padded, 1, length))
