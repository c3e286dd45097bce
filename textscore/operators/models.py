"""Distributed fits of text classifiers and choice of the best run."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textscore.functions.vectors import argmax
from textscore.functions.text import PADDING_ID
from textscore.operators import network
from textscore.operators.batches import BATCH_SIZE, bucket_batches, pad_to_batch_max
from textscore.operators.metrics import class_report, confusion_counts, metrics_report
from textscore.operators.matrix import ids_of
from textscore.operators.network import TokenModel
from textscore.session import delete_path, path_exists, scratch_path, via_table
from textscore.sources.writers import vocab_save


def _features(df: DataFrame, ids: str, vocab_size: int) -> tuple[DataFrame, CountVectorizerModel]:
    """Token counts per document. Ids are the vocabulary, so no pass is needed."""
    counter = CountVectorizerModel.from_vocabulary(
        [str(i) for i in range(vocab_size)], inputCol="_terms", outputCol="features"
    )
    return counter.transform(df.withColumn("_terms", F.col(ids).cast("array<string>"))), counter


def fit_classifier(
    df: DataFrame, ids: str, y: str, vocab_size: int, weight: str | None = None,
    reg: float = 0.01, max_iter: int = 20,
) -> Model:
    """K-way classifier on token counts; ``weight`` names a row weight column."""
    rows, _ = _features(df, ids, vocab_size)
    fitter = LogisticRegression(
        featuresCol="features", labelCol=y, family="multinomial", regParam=reg, maxIter=max_iter,
        predictionCol="_prediction", rawPredictionCol="_raw", probabilityCol="_probability",
    )
    if weight:
        fitter = fitter.setWeightCol(weight)
    return fitter.fit(rows)


def fit_ordinal(
    df: DataFrame, ids: str, y: str, vocab_size: int, k: int, weight: str | None = None,
    reg: float = 1e-5, max_iter: int = 60, dim: int = 0,
) -> TokenModel:
    """A model that minimises the ordinal loss: squared errors of K sigmoids, one per question "is the class j or above?"."""
    return network.fit(df, ids, y, vocab_size, k, network.ORDINAL, dim, weight, reg, max_iter)


def fit_network(
    df: DataFrame, ids: str, y: str, vocab_size: int, k: int, dim: int = 32, loss: str = network.CROSS_ENTROPY,
    weight: str | None = None, reg: float = 1e-6, max_iter: int = 60, seed: int = 0,
) -> TokenModel:
    """The mean-pool network ``W tanh(mean of token vectors) + b``, vectors and weights learnt together.

    ``model.vectors`` and ``model.weights`` are the tables that scoring and explanations take.
    """
    return network.fit(df, ids, y, vocab_size, k, loss, dim, weight, reg, max_iter, seed)


def predict_classifier(df: DataFrame, model: Model, ids: str, vocab_size: int) -> DataFrame:
    """Add logits ``z`` and class ``y_pred``."""
    rows, _ = _features(df, ids, vocab_size)
    scored = model.transform(rows).withColumn("z", vector_to_array("_raw"))
    return scored.select(*df.columns, "z", argmax(F.col("z")).alias("y_pred"))


def predict_ordinal(df: DataFrame, model: TokenModel, ids: str, vocab_size: int) -> DataFrame:
    """Add logits ``z`` and class ``y_pred``."""
    return network.apply(df, model, ids)


PLAIN, TOKENS = "plain", "tokens"


def save_model(model: Model | TokenModel, vocab: DataFrame, merges: DataFrame, out_dir: str) -> None:
    """A fitted model with the vocabulary that its features are counts of."""
    spark = vocab.sparkSession
    kind = TOKENS if isinstance(model, TokenModel) else PLAIN
    if kind == TOKENS:
        network.save(spark, model, f"{out_dir}/model")
    else:
        model.write().overwrite().save(f"{out_dir}/model")
    vocab_save(vocab, merges, out_dir)
    spark.createDataFrame([(kind,)], "kind string").write.mode("overwrite").json(f"{out_dir}/about")


def load_model(spark: SparkSession, path: str) -> tuple[Model | TokenModel, DataFrame, DataFrame]:
    """Model, vocabulary and merges written by :func:`save_model`."""
    about = spark.read.schema("kind string").json(f"{path}/about").first()
    load = network.load if about["kind"] == TOKENS else lambda _, at: LogisticRegressionModel.load(at)
    return load(spark, f"{path}/model"), spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/merges")


def predict(df: DataFrame, model: Model | TokenModel, ids: str, vocab_size: int) -> DataFrame:
    """Logits ``z`` and class ``y_pred`` by a plain or a token model."""
    return (predict_ordinal if isinstance(model, TokenModel) else predict_classifier)(df, model, ids, vocab_size)


@dataclass(frozen=True)
class Evaluation:
    """What a model does on labelled rows: predictions in batches, the matrix, the class table and the report."""

    predictions: DataFrame
    confusion: DataFrame
    classes: DataFrame
    report: DataFrame


def evaluate_model(df: DataFrame, model: Model | TokenModel, id: str, ids: str, y: str, vocab_size: int, k: int,
                   batch_size: int = BATCH_SIZE) -> Evaluation:
    """Apply a model to length-bucketed, padded batches and measure it.

    Rows are batched by length as a network would take them; a batch is padded with the padding
    id, which counts nothing. Predictions are written once and read by all measures.
    """
    placed = pad_to_batch_max(bucket_batches(df, ids, id, batch_size, shuffle=False), ids, out="_padded")
    real = F.filter("_padded", lambda i: i != PADDING_ID)
    scored = predict(placed.withColumn("_real", real), model, "_real", vocab_size)
    kept = scored.select(id, F.col(y).cast("int").alias("y_true"), "y_pred", "z", "batch_id", "n_tokens")
    pred = via_table(kept, "predictions")
    cm = confusion_counts(pred, k)
    return Evaluation(pred, cm, class_report(cm), metrics_report(pred, k, batch_size))


def explain_model(df: DataFrame, model: Model, ids: str, vocab_size: int) -> DataFrame:
    """Add ``scores`` (one per token), ``y_pred`` and ``z`` by a fitted plain classifier.

    For a linear model on token counts the integral of gradients is closed: the score of a token is its
    coefficient in the predicted class, and scores and intercept add up to the logit. The coefficients,
    classes x vocabulary numbers, travel to the tasks; the frame is mapped, not shuffled. Models above
    ``network.MAX_PARAMETERS`` numbers fail.
    """
    network.check_size(model.coefficientMatrix.numRows * model.coefficientMatrix.numCols)
    sent = df.sparkSession.sparkContext.broadcast(model.coefficientMatrix.toArray())

    @F.arrow_udf("array<double>")
    def scores(lists: pa.Array, chosen: pa.Array) -> pa.Array:
        counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.repeat(chosen.to_numpy(zero_copy_only=False).astype(np.int64), counts)
        at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(sent.value[rows, at]))

    found = predict_classifier(df, model, ids, vocab_size)
    return found.withColumn("scores", scores(F.col(ids).cast("array<int>"), F.col("y_pred").cast("int")))


def score_batches(df: DataFrame, model: PipelineModel | Model | Callable, schema: str | None = None, id: str = "row_id",
                  ids: str = "ids", batch: str = "batch_id") -> DataFrame:
    """Apply a fitted model to every row, or a function to every padded batch.

    A Spark ML model is transformed. A function gets the ids of one whole batch as a two-dimensional array and a mask of
    the same shape that is true at real tokens, and gives one row of logits per document: ``id, z``. All rows of ``batch``
    reach one call, whatever the size of Arrow batches; short rows are padded to its longest. ``schema`` is that of ``id``
    (``row_id bigint``).
    """
    if hasattr(model, "transform"):
        return model.transform(df)

    def scored(table: pa.Table) -> pa.Table:
        lists = table.column("ids").combine_chunks()
        flat, lengths = ids_of(lists)
        real = np.arange(lengths.max(initial=0)) < lengths[:, None]
        matrix = np.full(real.shape, PADDING_ID, np.int64)
        matrix[real] = flat
        z = np.asarray(model(matrix, real & (matrix != PADDING_ID)), float)
        ends = pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32())
        return pa.table({id: table.column("id"), "z": pa.ListArray.from_arrays(ends, pa.array(z.ravel()))})

    kind = schema or f"{id} {df.schema[id].dataType.simpleString()}"
    rows = df.select(F.col(batch).alias("batch"), F.col(id).alias("id"), F.col(ids).cast("array<int>").alias("ids"))
    return rows.groupBy("batch").applyInArrow(scored, f"{kind}, z array<double>")


def fit_epochs(train: DataFrame, valid: DataFrame, ids: str, y: str, vocab_size: int, k: int, loss: str, out_dir: str,
               epochs: int = 10, metric: str = "accuracy", dim: int = 0, weight: str | None = None,
               batch_size: int = BATCH_SIZE, reg: float = 1e-5, seed: int = 0) -> DataFrame:
    """Validation metrics after each epoch of one run: ``(epoch, accuracy, f1, loss)``; the best model is kept.

    An epoch is one step of the optimiser, which costs one pass over ``train`` (more where a step must be shortened). Its state and
    the metrics are written to ``out_dir`` after every epoch, and a call with the same folder goes on from there. The
    model with the strictly greatest metric above 0 is in ``out_dir/best``. ``valid`` has a column ``batch_id``.
    """
    spark = train.sparkSession
    rows = network.training_rows(train, ids, y, k, weight)
    valid = via_table(valid.select(ids, F.col(y).cast("int").alias("y_true"), "batch_id"), "valid")
    known = spark.read.parquet(f"{out_dir}/metrics").orderBy("epoch").collect() if path_exists(spark, f"{out_dir}/metrics") else []
    done = [(r["epoch"], r["accuracy"], r["f1"], r["loss"]) for r in known]
    state = network.load_state(spark, f"{out_dir}/state/epoch={len(done)}") if done else network.begin(
        rows, network.start(loss, vocab_size, k, dim, seed), reg)
    column = 1 if metric == "accuracy" else 2
    best = max([0.0, *(r[column] for r in done if r[column] is not None)])
    while len(done) < epochs:
        state = network.advance(rows, state, reg)
        report = metrics_report(network.apply(valid, state.model, ids), k, batch_size).first()
        row = (state.epoch, report["accuracy"], report["f1"], state.value)
        network.save_state(spark, state, f"{out_dir}/state/epoch={state.epoch}")
        if row[column] is not None and row[column] > best:
            best = row[column]
            network.save(spark, state.model, f"{out_dir}/best")
        spark.createDataFrame([row[1:]], "accuracy double, f1 double, loss double").coalesce(1).write.mode("overwrite").parquet(
            f"{out_dir}/metrics/epoch={state.epoch}")
        done.append(row)
        delete_path(spark, f"{out_dir}/state/epoch={state.epoch - 1}")
    return spark.createDataFrame(done[:epochs], "epoch int, accuracy double, f1 double, loss double")


def fit_epochs_table(
    train: DataFrame, valid: DataFrame, ids: str, y: str, vocab_size: int, k: int, epochs: int = 10,
    losses: Sequence[str] = network.LOSSES, weight: str | None = None, batch_size: int = BATCH_SIZE, reg: float = 1e-5,
    out_dir: str | None = None, dim: int = 0,
) -> DataFrame:
    """Validation metrics per run and epoch: ``(run, epoch, accuracy, f1)``, a run for each loss. See :func:`fit_epochs`.

    ``best_by_metric`` names the epoch whose model is in ``out_dir/<loss>/best``.
    """
    spark = train.sparkSession
    out_dir = out_dir or scratch_path(spark, "epochs")
    runs = [fit_epochs(train, valid, ids, y, vocab_size, k, loss, f"{out_dir}/{loss}", epochs, dim=dim, weight=weight,
                       batch_size=batch_size, reg=reg).select(F.lit(loss).alias("run"), "epoch", "accuracy", "f1") for loss in losses]
    return reduce(DataFrame.unionByName, runs)


def best_by_metric(runs: DataFrame, metric: str, run: str = "run", epoch: str = "epoch") -> DataFrame:
    """Best epoch of each run: greatest metric above 0, the first one on a tie.

    NULL and NaN never win.
    """
    valid = runs.where(F.col(metric).isNotNull() & ~F.isnan(metric) & (F.col(metric) > 0))
    best = F.max_by(F.struct(epoch, metric), F.struct(F.col(metric), -F.col(epoch)))
    return valid.groupBy(run).agg(best.alias("_best")).select(run, f"_best.{epoch}", f"_best.{metric}")


def best_so_far(runs: DataFrame, metric: str, run: str = "run", epoch: str = "epoch") -> DataFrame:
    """Mark the epochs at which a new best model would be saved."""
    earlier = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    value = F.when(~F.isnan(metric), F.col(metric))
    before = F.greatest(F.coalesce(F.max(value).over(earlier), F.lit(0.0)), F.lit(0.0))
    return runs.withColumn("best_before", before).withColumn(
        "is_best", F.coalesce(value > F.col("best_before"), F.lit(False))
    )
