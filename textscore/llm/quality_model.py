"""Quality classifier: boosted trees over statistics of the whole text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textscore.llm import boosted
from textscore.llm.common import ROWS_AT_ONCE, held_out, label_sample, slices, whole_text

FOLDS, HELD_FOLD = 4, 2
KEEP_FROM = 0.7
MAX_TRAIN = 20_000
LEAST_ROWS = 20

_SPACES = list(b" \t\n\x0b\x0c\r")
_DIGITS = list(range(48, 58))
_UPPER = list(range(65, 91))
_LOWER = list(range(97, 123))
_ENDS = list(b".?")
_COMMAS = list(b",;:")
_SYMBOLS = list(b"#*$%&|<>~^@_+=")
_BRACKETS = list(b"()[]{}\"'`/\\")

FEATURES = (
    "words", "word_length", "word_spread", "longest", "distinct", "commonest", "adjacent", "windows", "pairs", "lines", "line_words",
    "dup_lines", "upper", "digits", "ends", "commas", "symbols", "brackets", "exclaims", "pipes", "high_bytes", "capital_words", "symbol_words", "entropy",
)


def text_statistics(text: str) -> list[float]:
    """Statistics of one whole text, in the order of ``FEATURES``; all zero for a text without words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    body = max(1, int(len(raw) - counts[_SPACES].sum()))
    lengths = np.fromiter(map(len, words), np.int64, n)
    often = Counter(words)
    names = dict(zip(often, range(len(often))))
    ids = np.fromiter(map(names.__getitem__, words), np.int64, n)
    pair_of = np.unique(ids[:-1] * len(names) + ids[1:], return_inverse=True)
    windows = np.unique(pair_of[1][:-1] * len(names) + ids[2:])
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = counts[counts > 0] / len(raw)

    def of(chars: list[int]) -> float:
        return float(counts[chars].sum()) / body

    return [
        float(np.log1p(n)), float(lengths.mean()), float(lengths.std()), float(np.log1p(lengths.max())), len(often) / n,
        max(often.values()) / n, int((ids[:-1] == ids[1:]).sum()) / n,
        1 - len(windows) / (n - 2) if n > 2 else 0.0, 1 - len(pair_of[0]) / (n - 1) if n > 1 else 0.0,
        float(np.log1p(len(lines))), n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), of(_UPPER), of(_DIGITS),
        float(counts[_ENDS].sum()) / n, float(counts[_COMMAS].sum()) / n, float(counts[_SYMBOLS].sum()) / n, of(_BRACKETS),
        float(counts[33]) / n, float(counts[124]) / n, float(counts[128:].sum()) / body,
        sum(w[:1].isupper() for w in often) / len(often), sum(not w[-1:].isalnum() and w[-1] < 128 for w in often) / len(often),
        float(-(share * np.log2(share)).sum()),
    ]


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality") -> boosted.Forest | None:
    """Trees fitted on at most ``MAX_TRAIN`` labelled rows, the first by a hash of their id, none of the held-out fold.

    Labels of one class, or fewer than ``LEAST_ROWS``, give their smoothed rate as score; no labels give no model.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [text_statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(x, pa.list_(pa.float64()))], ["id", "label", "x"])

    sample = label_sample(labels, id_col, label_col, FOLDS, HELD_FOLD, MAX_TRAIN)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    rows = rows.join(F.broadcast(sample), "id").select("id", "text", "label")  # at most MAX_TRAIN rows of two numbers
    train = rows.mapInArrow(run, "id long, label int, x array<double>")
    train = train.orderBy(F.xxhash64("id"), "id", "x").limit(MAX_TRAIN).toPandas()  # ids may repeat
    if not len(train):
        return None
    x, y = np.stack(train["x"].to_numpy()), train["label"].to_numpy().astype(float)
    order = np.lexsort((*x.T, train["id"].to_numpy()))
    x, y = x[order], y[order]
    if len(train) < LEAST_ROWS or y.min() == y.max():
        return boosted.constant((y.sum() + 0.5) / (len(y) + 1))
    return boosted.fit(x, y)


def score_texts(spark: SparkSession, model: boosted.Forest | None):
    """A function of the text column that gives the score."""
    sent = spark.sparkContext.broadcast(model)  # arrays of at most trees * 2 ** (depth + 1) nodes

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            out = np.ones(len(part))
            if sent.value is not None:
                for at in range(0, len(part), ROWS_AT_ONCE):
                    x = np.array([text_statistics(t) for t in part.iloc[at:at + ROWS_AT_ONCE]])
                    out[at:at + ROWS_AT_ONCE] = sent.value.scores(x)
            yield pd.Series(out)

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Probability that a text is of good quality, for every row.

    Returns ``id_col``, ``held_out``, ``score`` and ``predicted`` (score at least 0.7). Inputs of the score are statistics of the
    whole text only; for the model see :func:`fit_quality`. One pass without a shuffle. Null and empty texts have zeros as
    statistics. Without labels the score is 1, as nothing speaks against a text. Repeated rows score alike. Other
    columns are left out. No rows give no rows.
    """
    score = score_texts(docs.sparkSession, fit_quality(docs, labels, id_col, text_col, label_col))
    scored = docs.select(F.col(id_col).cast("long").alias(id_col), held_out(id_col, FOLDS, HELD_FOLD).alias("held_out"),
                         score(whole_text(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= KEEP_FROM).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` whose score is at least 0.7, with all their columns."""
    score = score_texts(docs.sparkSession, fit_quality(docs, labels, id_col, text_col, label_col))
    return docs.where(score(whole_text(text_col)) >= KEEP_FROM)
