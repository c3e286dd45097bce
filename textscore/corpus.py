"""The roles that columns of a corpus play."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Corpus:
    """A labelled text table: key, text, label and category columns."""

    df: DataFrame
    id: str
    x: str
    y: str
    cat: str

    def with_df(self, df: DataFrame) -> "Corpus":
        return replace(self, df=df)


def reviews_corpus(df: DataFrame) -> Corpus:
    return Corpus(df, "row_id", "reviewText", "overall", "type")


def essays_corpus(df: DataFrame) -> Corpus:
    return Corpus(df, "essay_id", "essay", "domain1_score", "essay_set")
