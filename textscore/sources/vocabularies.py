"""Vocabularies by name: the one asked for, else the default of its corpus, else one trained there and then."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from textscore.functions.text import ENTITY_TAGS, PADDING_TOKEN
from textscore.operators.bpe import bpe_train
from textscore.session import path_exists
from textscore.sources.readers import vocab_load
from textscore.sources.writers import vocab_save


@dataclass(frozen=True)
class VocabularyKind:
    """The folder and the default name of a corpus' vocabularies, and how one is trained."""

    folder: str
    default: str
    special: tuple[str, ...]
    lowercase: bool
    vocab_size: int = 1000


# Names and training settings of the two corpora.
REVIEWS = VocabularyKind("reviews", "reviews_tokenizer", (PADDING_TOKEN,), True)
ESSAYS = VocabularyKind("essays", "essays_tokenizer", (PADDING_TOKEN, *ENTITY_TAGS), False)


@dataclass(frozen=True)
class Vocabulary:
    """Tokens and merges, the name they are stored under, and whether they were trained by this call."""

    vocab: DataFrame
    merges: DataFrame
    name: str
    trained: bool


def find_vocabulary(spark: SparkSession, root: str, kind: VocabularyKind, name: str) -> str | None:
    """Path of a stored vocabulary: a folder of tables that were written to the end, or a tokenizer JSON file."""
    path = f"{root.rstrip('/')}/{kind.folder}/{name}"
    if all(path_exists(spark, f"{path}/{part}/_SUCCESS") for part in ("vocab", "merges")):
        return path
    return f"{path}.json" if path_exists(spark, f"{path}.json") else None


def load_or_train(spark: SparkSession, root: str, kind: VocabularyKind, texts: Callable[[], DataFrame], x: str,
                  name: str | None = None) -> Vocabulary:
    """The vocabulary ``name`` below ``root``; if there is none, the default of ``kind``; if that is missing too, a new one.

    A new one is trained on column ``x`` of ``texts()`` with the settings of ``kind`` and stored under ``name``, or under the
    default name if none was given, so that the next call finds it; ``texts`` is not called otherwise. What is passed on was
    read back from storage. Only a vocabulary that is not there is replaced: one that cannot be read fails, and one whose
    writing broke off counts as missing and is written anew.
    """
    for stored in dict.fromkeys((name or kind.default, kind.default)):
        path = find_vocabulary(spark, root, kind, stored)
        if path:
            return Vocabulary(*vocab_load(spark, path), stored, False)
    stored = name or kind.default
    path = f"{root.rstrip('/')}/{kind.folder}/{stored}"
    vocab_save(*bpe_train(texts(), x, kind.vocab_size, kind.special, kind.lowercase), path)
    return Vocabulary(*vocab_load(spark, path), stored, True)
