"""Apply text classifiers: mean-pooled embeddings, logits, decoding, losses.

Documents carry their token ids as an array, one row per document. Token
vectors live in a table ``(token_id, v)``; it is joined by broadcast when the
numbers in it are few and by a salted join otherwise, since a frequent token
may hold a large share of all occurrences.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textscore.functions.text import PADDING_ID
from textscore.functions.vectors import argmax, array_sum, dot, log_sum_exp, sum_vectors
from textscore.operators.matrix import LEAD, SentMatrix, by_parts, ids_of
from textscore.session import parallelism, via_table

#: Numbers of vectors that tasks map from a file on their machine; more are joined to the tokens.
VECTOR_NUMBERS = 1_000_000_000
#: Numbers of vectors that a join keeps in each executor's memory.
JOINED_NUMBERS = 16_000_000
#: Numbers that the driver fetches at once; more come by partition.
COLLECTED_NUMBERS = 4_000_000


def lookup_vectors(tokens: DataFrame, vecs: DataFrame, spread: Column) -> DataFrame:
    """Join token rows to their vectors on ``token_id``.

    ``spread`` is any column that differs between occurrences of one token; it picks the copy of the vector in the join
    of a larger matrix, where a token has as many copies as its share of all rows asks for: one, unless it is
    frequent. A token without a vector fails, as leaving it out would change every mean it is part of.
    """
    numbers = vecs.agg(F.sum(F.size("v"))).first()[0] or 0
    if numbers <= min(JOINED_NUMBERS, VECTOR_NUMBERS):
        return _with_vector(tokens.join(F.broadcast(vecs), "token_id", "left"))
    copies = F.broadcast(copies_of_frequent(tokens))
    one = F.coalesce("_copies", F.lit(1))
    copied = vecs.join(copies, "token_id", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_copies")
    salted = tokens.join(copies, "token_id", "left").withColumn("_salt", F.pmod(F.hash(spread), one)).drop("_copies")
    return _with_vector(salted.join(copied, ["token_id", "_salt"], "left").drop("_salt"))


def copies_of_frequent(tokens: DataFrame) -> DataFrame:
    """``token_id, _copies`` of the tokens that hold more than a quarter of a partition's fair share of all rows.

    Counts are combined on the map side. There are at most ``4 * parallelism`` such tokens, whatever the size of the table.
    """
    spark = tokens.sparkSession
    counts = tokens.groupBy("token_id").agg(F.count(F.lit(1)).alias("n")).where("token_id IS NOT NULL")
    pieces = 4 * parallelism(spark)
    shares = via_table(counts, "token-counts")
    rows = shares.agg(F.sum("n")).first()[0] or 0
    frequent = shares.where(F.col("n") * pieces > rows).select("token_id", F.ceil(F.col("n") * pieces / F.lit(max(1, rows))).cast("int").alias("_copies"))
    return spark.createDataFrame(frequent.collect(), frequent.schema)


def _with_vector(rows: DataFrame) -> DataFrame:
    missing = F.raise_error(F.concat(F.lit("no vector for token id "), F.coalesce(F.col("token_id").cast("string"), F.lit("NULL"))))
    return rows.withColumn("v", F.coalesce("v", missing))


def explode_ids(docs: DataFrame, id: str, ids: str) -> DataFrame:
    """One row per token.

    The outer form keeps the optimizer from adding a filter on the array,
    which would compute the expression behind it twice.
    """
    return docs.select(id, F.posexplode_outer(ids).alias("pos", "token_id")).where(F.col("pos").isNotNull())


def embed_tokens(tokens: DataFrame, vecs: DataFrame) -> DataFrame:
    """Token rows ``(…, pos, token_id)`` with their vector ``v``."""
    return lookup_vectors(tokens, vecs, F.col("pos"))


def mean_pool(docs: DataFrame, id: str, ids: str, vecs: DataFrame, dim: int, skip_pad: bool = False) -> DataFrame:
    """Mean vector ``m`` and ``n_tokens`` per document with tokens, padding included unless ``skip_pad``.

    With a matrix of checked size this is one map over the documents. A larger one is joined to the
    tokens; all of a document come from one row, so its sums are finished on
    the map side and the shuffle carries one row per document.
    """
    matrix = mapped_matrix(vecs, dim)
    if matrix is not None:
        return _pool_in_place(docs, id, ids, matrix, skip_pad)
    tokens = explode_ids(docs, id, ids)
    if skip_pad:
        tokens = tokens.where(F.col("token_id") != PADDING_ID)
    sums = embed_tokens(tokens, vecs).groupBy(id).agg(
        sum_vectors(F.col("v"), dim).alias("_s"), F.count(F.lit(1)).alias("n_tokens")
    )
    return sums.select(id, "n_tokens", F.transform("_s", lambda s: s / F.col("n_tokens")).alias("m"))


def mapped_matrix(vecs: DataFrame, dim: int, bounded: bool = True) -> SentMatrix | None:
    """The vectors in every task, or None if there are more numbers than ``VECTOR_NUMBERS`` and they are ``bounded``.

    They pass through the driver a few thousand rows at a time into a file, which is broadcast and mapped by the tasks; numbers
    of single precision stay so there.
    """
    spark = vecs.sparkSession
    numbers = vecs.agg(F.sum(F.size("v"))).first()[0] or 0
    if bounded and numbers > VECTOR_NUMBERS:
        return None
    single = vecs.schema["v"].dataType.simpleString() == "array<float>"
    dtype = np.dtype(np.float32 if single else np.float64)
    rows = vecs.select(F.col("token_id").cast("bigint").alias("id"), F.col("v").cast(f"array<{'float' if single else 'double'}>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.columns
            flat = lists.flatten()
            sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            if ids.null_count or flat.null_count or (sizes != dim).any():
                raise ValueError(f"a token id is null, or a vector does not hold {dim} numbers")
            yield pa.RecordBatch.from_pydict({"ids": [ids.to_numpy().tobytes()], "v": [flat.to_numpy().tobytes()]})

    packs = rows.mapInArrow(pack, "ids binary, v binary")
    ids = [np.zeros(0, np.int64)]
    with tempfile.TemporaryFile() as f:
        f.write(bytes(LEAD))
        for row in packs.collect() if numbers <= COLLECTED_NUMBERS else packs.toLocalIterator():
            ids.append(np.frombuffer(row["ids"], np.int64))
            f.write(row["v"])
        return SentMatrix(spark, np.concatenate(ids), f, dtype, dim)


def _pool_in_place(docs: DataFrame, id: str, ids: str, sent: SentMatrix, skip_pad: bool) -> DataFrame:
    def of_part(lists: pa.Array) -> pa.Array:
        flat, lengths = ids_of(lists)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        if skip_pad:
            flat, doc = flat[flat != PADDING_ID], doc[flat != PADDING_ID]
            lengths = np.bincount(doc, minlength=len(lengths))
        matrix = sent.value
        means = matrix.sums(matrix.places(flat), doc, len(lengths)) / np.maximum(lengths, 1)[:, None]
        ends = pa.array(np.arange(len(lengths) + 1) * means.shape[1], pa.int32())
        return pa.StructArray.from_arrays([pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(means.ravel()))], ["n_tokens", "m"])

    pool = F.arrow_udf(lambda lists: by_parts(of_part, lists), "struct<n_tokens:long,m:array<double>>")
    pool = pool.asNondeterministic()  # else the filter below would compute it a second time
    pooled = docs.select(id, pool(F.col(ids).cast("array<int>")).alias("_pooled"))
    return pooled.select(id, "_pooled.n_tokens", "_pooled.m").where(F.col("n_tokens") > 0)


def model_column(weights: DataFrame) -> Column:
    """Class weights ``(class, w, b)`` as one array value, in class order.

    The model is classes x dimensions numbers; a scalar subquery hands it to
    every task without a join.
    """
    return weights.agg(F.array_sort(F.collect_list(F.struct("class", "w", "b"))).alias("model")).scalar()


def dan_logit_arrays(pooled: DataFrame, weights: DataFrame, out: str = "z") -> DataFrame:
    """``W tanh(mean) + b`` as one array per document."""
    squashed = F.transform("m", lambda x: F.tanh(x))
    return (
        pooled.withColumn("_t", squashed).withColumn("_model", model_column(weights))
        .withColumn(out, F.transform("_model", lambda c: dot(F.col("_t"), c["w"]) + c["b"]))
        .drop("_t", "_model")
    )


def dan_logits(pooled: DataFrame, id: str, weights: DataFrame) -> DataFrame:
    """One row per document and class."""
    scored = dan_logit_arrays(pooled, weights)
    return scored.select(id, F.posexplode("z").alias("class", "logit"))


def predict_argmax(df: DataFrame, z: str = "z", out: str = "y_pred") -> DataFrame:
    """Class of the greatest logit; the lowest class on a tie."""
    return df.withColumn(out, argmax(F.col(z)))


def predict_argmax_long(logits: DataFrame, id: str) -> DataFrame:
    """The same from a long table ``(id, class, logit)``."""
    best = F.max_by("class", F.struct(F.col("logit"), -F.col("class")))
    return logits.groupBy(id).agg(best.alias("y_pred"))


def ordinal_encode(df: DataFrame, y: str, k: int, out: str = "encoded") -> DataFrame:
    """Label y as a K-vector: 1 up to and including position y."""
    return df.withColumn(
        out, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: (j <= F.col(y)).cast("int"))
    )


def ordinal_class(z: Column) -> Column:
    """Length of the leading run of positive logits minus one, at least 0."""
    run = F.aggregate(
        z,
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, v: F.struct(
            (acc["n"] + (acc["on"] & (v > 0)).cast("int")).alias("n"), (acc["on"] & (v > 0)).alias("on")
        ),
    )
    return F.greatest(run["n"] - 1, F.lit(0)).cast("int")


def ordinal_decode(df: DataFrame, z: str = "z", out: str = "y_pred") -> DataFrame:
    return df.withColumn(out, ordinal_class(F.col(z)))


def _sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-v))


def class_weight_of(y: Column, weights: list[float] | None) -> Column:
    """Weight of the row's class, from a list with one number per class."""
    return F.lit(1.0) if weights is None else F.get(F.array(*[F.lit(float(w)) for w in weights]), y)


def ordinal_row_loss(z: Column, y: Column, weights: list[float] | None = None) -> Column:
    errors = F.transform(z, lambda v, j: F.pow(_sigmoid(v) - (j <= y).cast("double"), F.lit(2.0)))
    return class_weight_of(y, weights) * array_sum(errors)


def ordinal_loss(df: DataFrame, z: str, y: str, weights: list[float] | None = None) -> DataFrame:
    """Sum (not mean) over rows of the weighted squared errors."""
    return df.agg(F.sum(ordinal_row_loss(F.col(z), F.col(y), weights)).alias("loss"))


def negative_log_likelihood(z: Column, y: Column) -> Column:
    return log_sum_exp(z) - F.get(z, y)


def cross_entropy(df: DataFrame, z: str, y: str, weights: list[float] | None = None) -> DataFrame:
    """Weighted mean of the negative log softmax at the label."""
    w = class_weight_of(F.col(y), weights)
    loss = F.sum(w * negative_log_likelihood(F.col(z), F.col(y)))
    return df.agg((loss / F.sum(w)).alias("loss"))
