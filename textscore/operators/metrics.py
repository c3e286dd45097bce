"""Confusion matrices and the metrics drawn from them.

A confusion matrix is a long table ``(y_true, y_pred, n)`` with K x K rows;
all metrics work on that table and no longer on the predictions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textscore.operators.batches import BATCH_SIZE
from textscore.operators.scoring import (
    class_weight_of, negative_log_likelihood, ordinal_row_loss,
)

RUN_BLOCK = 65_536


def checked_class(name: str, k: int) -> Column:
    """The class; fails where it is not one of the K classes, so that no row is lost without a word."""
    wrong = F.concat(F.lit(f"{name} is no class from 0 to {k - 1}: "), F.coalesce(F.col(name).cast("string"), F.lit("NULL")))
    return F.when(F.col(name).between(0, k - 1), F.col(name)).otherwise(F.raise_error(wrong)).alias(name)


def fill_grid(counts: DataFrame, k: int) -> DataFrame:
    """All K x K cells, zeros kept. A label or prediction outside the classes, or NULL, fails."""
    counts = counts.select(checked_class("y_true", k), checked_class("y_pred", k), "n")
    grid = counts.sparkSession.range(k * k, numPartitions=1).select(
        F.floor(F.col("id") / k).cast("int").alias("y_true"), (F.col("id") % k).cast("int").alias("y_pred")
    )
    return grid.join(counts, ["y_true", "y_pred"], "left").select(
        "y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def confusion_cells(pred: DataFrame) -> DataFrame:
    return pred.groupBy(
        F.col("y_true").cast("int").alias("y_true"), F.col("y_pred").cast("int").alias("y_pred")
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_counts(pred: DataFrame, k: int) -> DataFrame:
    """Rows per true and predicted class."""
    return fill_grid(confusion_cells(pred), k)


def confusion_normalized(cm: DataFrame) -> DataFrame:
    """Each row divided by its sum; a class without rows gives NULL."""
    total = F.sum("n").over(Window.partitionBy("y_true"))
    return cm.select("y_true", "y_pred", F.try_divide(F.col("n").cast("double"), total.cast("double")).alias("share"))


def confusion_wide(cm: DataFrame, k: int, value: str = "n") -> DataFrame:
    """Matrix form: one row per true class, one column per predicted class."""
    return cm.groupBy("y_true").agg(*[
        F.max(F.when(F.col("y_pred") == j, F.col(value))).alias(f"pred_{j}") for j in range(k)
    ])


def _class_table(cm: DataFrame) -> DataFrame:
    """Correct, true, predicted and all rows per class."""
    hits = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    truth = cm.groupBy(F.col("y_true").alias("class")).agg(
        F.sum(hits).alias("correct"), F.sum("n").alias("total")
    )
    predicted = cm.groupBy(F.col("y_pred").alias("class")).agg(F.sum("n").alias("predicted"))
    every = F.sum("total").over(Window.partitionBy(F.lit(0)))
    return truth.join(predicted, "class").withColumn("all_rows", every)


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def per_class_accuracy(cm: DataFrame) -> DataFrame:
    rate = 100 * _ratio(F.col("correct"), F.col("total"))
    return _class_table(cm).select(
        "class", "correct", "total", rate.alias("accuracy"),
        F.format_string("%d / %d", "correct", "total").alias("ratio"),
    )


def precision_recall_f1(cm: DataFrame, mode: str = "reference") -> DataFrame:
    """Precision, recall and f1 per class; NULL where a ratio has no base.

    Mode ``reference`` divides the hits by the rows of the class and by all
    rows. Mode ``standard`` uses the predicted rows and the rows of the class.
    """
    bases = {"reference": ("total", "all_rows"), "standard": ("predicted", "total")}
    if mode not in bases:
        raise ValueError(f"unknown mode: {mode}")
    p, r = (_ratio(F.col("correct"), F.col(b)) for b in bases[mode])
    return (
        _class_table(cm).withColumn("precision", p).withColumn("recall", r)
        .withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
        .select("class", "correct", "total", "precision", "recall", "f1")
    )


def harmonic_f1(k: Column, inverse_sum: Column) -> Column:
    """K over the sum of 1/f1; infinite if no class has an f1."""
    return F.when(inverse_sum.isNull(), F.lit(float("inf"))).otherwise(k / inverse_sum)


def macro_f1_harmonic(cm: DataFrame, mode: str = "reference") -> DataFrame:
    """Harmonic mean of f1 in which classes without f1 still count in K."""
    return precision_recall_f1(cm, mode).agg(
        harmonic_f1(F.count(F.lit(1)), F.sum(1 / F.col("f1"))).alias("f1")
    )


def accuracy(pred: DataFrame, batch_size: int = BATCH_SIZE, batch: str = "batch_id") -> DataFrame:
    """Percent correct by rows, and by full batches as if none were partial.

    The batch column numbers the batches from 0.
    """
    correct = F.count_if(F.col("y_true") == F.col("y_pred"))
    return pred.agg(
        (100 * correct / F.count(F.lit(1))).alias("accuracy_exact"),
        (100 * correct / ((F.max(batch) + 1) * batch_size)).alias("accuracy_batched"),
    )


def metrics_report(pred: DataFrame, k: int, batch_size: int = BATCH_SIZE, batch: str = "batch_id") -> DataFrame:
    """One row: accuracy over full batches and harmonic f1, from one pass.

    The pass counts (true, predicted) cells and the last batch of each.
    """
    cells = pred.groupBy(
        F.col("y_true").cast("int").alias("y_true"), F.col("y_pred").cast("int").alias("y_pred")
    ).agg(F.count(F.lit(1)).alias("n"), F.max(batch).alias("last"))
    row = (
        cells.groupBy("y_true").agg(
            F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("correct"),
            F.sum("n").alias("total"), F.max("last").alias("last"),
        )
        .withColumn("all_rows", F.sum("total").over(Window.partitionBy(F.lit(0))))
        .withColumn("p", _ratio(F.col("correct"), F.col("total")))
        .withColumn("r", _ratio(F.col("correct"), F.col("all_rows")))
        .withColumn("inv", F.try_divide(F.col("p") + F.col("r"), 2 * F.col("p") * F.col("r")))
    )
    return row.agg(
        (100 * F.sum("correct") / ((F.max("last") + 1) * batch_size)).alias("accuracy"),
        harmonic_f1(F.lit(k), F.sum("inv")).alias("f1"),
    )


def class_report(cm: DataFrame) -> DataFrame:
    """The table behind the class chart: ratios with 2 places and counts."""
    return precision_recall_f1(cm).select(
        (F.col("class") + 1).alias("class"),
        *[F.round(c, 2).alias(c) for c in ("precision", "recall", "f1")],
        "correct", "total",
    )


def row_loss(kind: str, z: str, y: str, weights: list[float] | None = None) -> Column:
    """Loss of one row for ``ordinal`` or ``cross_entropy``."""
    if kind == "ordinal":
        return ordinal_row_loss(F.col(z), F.col(y), weights)
    if kind == "cross_entropy":
        return class_weight_of(F.col(y), weights) * negative_log_likelihood(F.col(z), F.col(y))
    raise ValueError(f"unknown loss: {kind}")


def running_metrics(
    pred: DataFrame, batch_size: int = BATCH_SIZE, batch: str = "batch_id", loss: Column | None = None,
    mean_loss: bool = True,
) -> DataFrame:
    """Cumulative correct rows, loss and accuracy after each batch.

    Rows are first summed per batch. The running sums go over batches in
    blocks, so that no task has to walk through all of them.
    """
    value = F.lit(0.0) if loss is None else loss
    batches = pred.groupBy(batch).agg(
        F.count_if(F.col("y_true") == F.col("y_pred")).alias("c"),
        (F.avg(value) if mean_loss else F.sum(value)).alias("l"),
    ).withColumn("_block", F.floor(F.col(batch) / RUN_BLOCK))
    totals = batches.groupBy("_block").agg(F.sum("c").alias("bc"), F.sum("l").alias("bl"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_block", F.coalesce(F.sum("bc").over(before), F.lit(0)).alias("c0"),
        F.coalesce(F.sum("bl").over(before), F.lit(0.0)).alias("l0"),
    )
    upto = Window.partitionBy("_block").orderBy(batch).rowsBetween(Window.unboundedPreceding, 0)
    seen = (F.col(batch) + 1) * batch_size
    return batches.join(starts, "_block").select(
        batch,
        (F.col("c0") + F.sum("c").over(upto)).alias("correct"),
        (F.col("l0") + F.sum("l").over(upto)).alias("loss"),
    ).withColumn("accuracy", 100 * F.col("correct") / seen).withColumn("mean_loss", F.col("loss") / seen)


def metric_every_n_steps(log: DataFrame, n: int, step: str = "step", skip_first: bool = False) -> DataFrame:
    """Each n-th step of a log; ``skip_first`` leaves step 0 out."""
    kept = log.where(F.col(step) % n == 0)
    return kept.where(F.col(step) > 0) if skip_first else kept


def prediction_vs_actual(pred: DataFrame, labels: DataFrame, id: str, y: str) -> DataFrame:
    """Predicted class (from 1) next to the actual label."""
    return pred.join(labels, id).select(
        id, (F.col("y_pred") + 1).alias("pred"), F.col(y).alias("actual")
    )

