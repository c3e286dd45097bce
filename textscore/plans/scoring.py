"""Queries over scoring, fits, metrics and explanations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from textscore.operators import batches, explain, labels, metrics, models, network, sampling, scoring
from textscore.operators.tokens import pretoken_spans
from textscore.functions.hashing import hash_int
from textscore.plans import views
from textscore.plans.registry import query
from textscore.plans.tokens import _PADDED, VOCAB_SIZE, encoded_reviews, trained
from textscore.plans.views_sql import h
from textscore.session import made_once, scratch_path, via_table
from textscore.streaming.running import running_confusion_stream, running_metrics_stream

K = views.REVIEW_CLASSES
DIM = views.DIM
CLASS_WEIGHTS = [8.0, 4.0, 3.0, 2.0, 1.0]
_W = "(CASE y_true WHEN 0 THEN 8.0::DOUBLE WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 1 END)"


def _docs(spark, d):
    return views.token_docs(spark, d)


def _pooled(spark, d):
    return scoring.mean_pool(_docs(spark, d), "doc_id", "ids", views.vectors(spark, d), DIM)


@query("embed_tokens", """
    SELECT doc_id, pos::INT AS pos, id::INT AS id, round(v[1], 6) AS v_first, round(v[64], 6) AS v_last,
           round(list_sum(v), 6) AS v_sum
    FROM v_tokens JOIN v_vec USING (id)""")
def embed_tokens(spark, d):
    tokens = scoring.explode_ids(_docs(spark, d), "doc_id", "ids")
    sums = views.vectors(spark, d).withColumn("s", scoring.array_sum(F.col("v").cast("array<double>")))
    return scoring.embed_tokens(tokens, sums).select(
        "doc_id", "pos", F.col("token_id").alias("id"), F.round(F.get("v", F.lit(0)).cast("double"), 6).alias("v_first"),
        F.round(F.get("v", F.lit(63)).cast("double"), 6).alias("v_last"), F.round("s", 6).alias("v_sum"),
    )


@query("mean_pool", "SELECT doc_id, d::INT AS dim, round(m, 9) AS m FROM v_pooled")
def mean_pool(spark, d):
    return _pooled(spark, d).select("doc_id", F.posexplode("m").alias("dim", "m")).withColumn("m", F.round("m", 9))


@query("mean_pool_skip_pad", """
    SELECT doc_id, d::INT AS dim, round(sum(n * x) / sum(n), 9) AS m
    FROM v_counts JOIN v_dims USING (id) WHERE id <> 0 GROUP BY doc_id, d""")
def mean_pool_skip_pad(spark, d):
    pooled = scoring.mean_pool(_docs(spark, d), "doc_id", "ids", views.vectors(spark, d), DIM, skip_pad=True)
    return pooled.select("doc_id", F.posexplode("m").alias("dim", "m")).withColumn("m", F.round("m", 9))


@query("dan_logits", "SELECT doc_id, class::INT AS class, round(logit, 9) AS logit FROM v_doc_logits")
def dan_logits(spark, d):
    logits = scoring.dan_logits(_pooled(spark, d), "doc_id", views.class_weight(spark, d))
    return logits.withColumn("logit", F.round("logit", 9))


@query("predict_argmax", "SELECT doc_id, class::INT AS y_pred FROM v_doc_pred")
def predict_argmax(spark, d):
    scored = scoring.dan_logit_arrays(_pooled(spark, d), views.class_weight(spark, d))
    return scoring.predict_argmax(scored).select("doc_id", "y_pred")


@query("predict_argmax_long", """
    SELECT row_id, (list_position(z, list_max(z)) - 1)::INT AS y_pred FROM v_logits""")
def predict_argmax_long(spark, d):
    long = views.logits(spark, d).select("row_id", F.posexplode("z").alias("class", "logit"))
    return scoring.predict_argmax_long(long, "row_id")


@query("ordinal_encode", """
    SELECT row_id, array_to_string(list_transform(range(5), lambda j: CASE WHEN j <= y_true THEN 1 ELSE 0 END), ' ') AS encoded
    FROM v_predictions""")
def ordinal_encode(spark, d):
    rows = views.reviews(spark, d).select("row_id", (F.col("overall") - 1).alias("y_true"))
    encoded = scoring.ordinal_encode(rows, "y_true", K)
    return encoded.select("row_id", F.array_join(F.col("encoded").cast("array<string>"), " ").alias("encoded"))


@query("ordinal_decode", """
    SELECT row_id, CASE WHEN z[1] <= 0 THEN 0 WHEN z[2] <= 0 THEN 0 WHEN z[3] <= 0 THEN 1 WHEN z[4] <= 0 THEN 2
                        WHEN z[5] <= 0 THEN 3 ELSE 4 END AS y_pred FROM v_logits""")
def ordinal_decode(spark, d):
    return scoring.ordinal_decode(views.logits(spark, d)).select("row_id", "y_pred")


_ORDINAL_ROW = " + ".join(
    f"pow(1 / (1 + exp(-z[{j + 1}])) - CASE WHEN {j} <= y_true THEN 1 ELSE 0 END, 2)" for j in range(5)
)
_NLL = "(ln(list_sum(list_transform(z, lambda v: exp(v)))) - z[y_true + 1])"


@query("ordinal_loss", f"SELECT round(sum({_W} * ({_ORDINAL_ROW})), 6) AS loss FROM v_logits")
def ordinal_loss(spark, d):
    return scoring.ordinal_loss(views.logits(spark, d), "z", "y_true", CLASS_WEIGHTS).select(
        F.round("loss", 6).alias("loss")
    )


@query("cross_entropy", f"SELECT round(sum({_W} * {_NLL}) / sum({_W}), 6) AS loss FROM v_logits")
def cross_entropy(spark, d):
    return scoring.cross_entropy(views.logits(spark, d), "z", "y_true", CLASS_WEIGHTS).select(
        F.round("loss", 6).alias("loss")
    )


# ---------------------------------------------------------------- fits

def _train_rows(spark, d):
    return encoded_reviews(spark, d).select("row_id", "ids", "overall", (F.col("overall") - 1).cast("double").alias("y"))


def _with_weights(spark, d, rows):
    weights = labels.class_weights(views.reviews(spark, d), "overall").select("overall", "weight")
    return rows.join(F.broadcast(weights), "overall")


@query("fit_classifier")
def fit_classifier(spark, d):
    rows = _with_weights(spark, d, _train_rows(spark, d))
    model = models.fit_classifier(rows, "ids", "y", VOCAB_SIZE, weight="weight")
    return models.predict_classifier(rows, model, "ids", VOCAB_SIZE).select("row_id", "y", "y_pred")


@query("fit_ordinal")
def fit_ordinal(spark, d):
    rows = _train_rows(spark, d)
    fitted = models.fit_ordinal(rows, "ids", "y", VOCAB_SIZE, K)
    return models.predict_ordinal(rows, fitted, "ids", VOCAB_SIZE).select("row_id", "y", "y_pred")


MARKER_REPEATS = 12


def _marked_docs(spark, d):
    """Documents whose label some of their tokens decide: an id per class is added to the hashed words."""
    words = table_size(spark, d)
    y = (hash_int(F.col("doc_id"), "marked") % K).cast("int")
    ids = F.concat(F.transform("ids", lambda i: i + 1), F.array_repeat(y + words + 1, MARKER_REPEATS))
    return _docs(spark, d).select("doc_id", y.alias("y"), ids.alias("ids")), words + K + 1


def table_size(spark, d):
    return views.table(spark, d, "embeddings").count()


_MARKED = f"SELECT doc_id, ({h('doc_id', 'marked')} % {K})::INT AS y FROM documents"


@query("fit_save_evaluate", f"SELECT y AS y_true, y AS y_pred, count(*) AS n FROM ({_MARKED}) GROUP BY y")
def fit_save_evaluate(spark, d):
    """A classifier is fitted, saved with its vocabulary, loaded and measured on padded batches."""
    rows, size = _marked_docs(spark, d)
    vocab = spark.range(size).select(F.col("id").cast("string").alias("token"), F.col("id").cast("int").alias("id"))
    merges = vocab.limit(0).select(F.lit(0).alias("rank"), F.col("token").alias("left"), F.col("token").alias("right"))
    path = scratch_path(spark, "model")
    models.save_model(models.fit_classifier(rows, "ids", "y", size, reg=0.001), vocab, merges, path)
    model, vocab, _ = models.load_model(spark, path)
    found = models.evaluate_model(rows, model, "doc_id", "ids", "y", vocab.count(), K, views.BATCH)
    return found.confusion.where("n > 0")


@query("fit_ordinal_evaluate", f"SELECT y AS y_true, y AS y_pred, count(*) AS n FROM ({_MARKED}) GROUP BY y")
def fit_ordinal_evaluate(spark, d):
    rows, size = _marked_docs(spark, d)
    fitted = models.fit_ordinal(rows, "ids", "y", size, K, max_iter=30)
    return models.evaluate_model(rows, fitted, "doc_id", "ids", "y", size, K, views.BATCH).confusion.where("n > 0")


def _decided_docs(spark, d):
    """The same with as many marks as words, so that their mean decides."""
    words = table_size(spark, d)
    y = (hash_int(F.col("doc_id"), "marked") % K).cast("int")
    ids = F.concat(F.transform("ids", lambda i: i + 1), F.array_repeat(y + words + 1, F.size("ids") + 1))
    return _docs(spark, d).select("doc_id", y.alias("y"), ids.alias("ids")), words + K + 1


def _network(spark, d):
    """A network fitted to decided labels, kept as its numbers."""
    def build():
        rows, size = _decided_docs(spark, d)
        return models.fit_network(rows, "ids", "y", size, K, dim=8, max_iter=40)

    return made_once(spark, ("network", views.stamp(spark, d, "documents"), views.stamp(spark, d, "embeddings")), build)


@query("fit_network_evaluate", f"SELECT y AS y_true, y AS y_pred, count(*) AS n FROM ({_MARKED}) GROUP BY y")
def fit_network_evaluate(spark, d):
    """The mean-pool network is fitted, saved, loaded and measured on padded batches."""
    rows, size = _decided_docs(spark, d)
    path = scratch_path(spark, "network")
    network.save(spark, _network(spark, d), path)
    return models.evaluate_model(rows, network.load(spark, path), "doc_id", "ids", "y", size, K, views.BATCH).confusion.where("n > 0")


@query("explain_network", f"SELECT doc_id, y AS y_pred, true AS adds_up FROM ({_MARKED})")
def explain_network(spark, d):
    """Integrated gradients over fitted vectors: scores add up to the gain of the predicted class, in every document."""
    rows, _ = _decided_docs(spark, d)
    model = _network(spark, d)
    weights = model.weights(spark)
    scored = explain.token_scores(rows, "doc_id", "ids", model.vectors(spark), weights, model.dim)
    both = explain.ig_completeness(scored.select("doc_id", "scores", "y_pred", "z"), "doc_id", weights, model.dim, "y_pred", empty=True)
    both = via_table(both, "completeness")  # a few numbers a document; else both sides of the join would score all tokens
    sums = both.where("attributed IS NOT NULL").select("doc_id", (F.abs(F.col("attributed") - F.col("gain")) < 1e-6).alias("adds_up"))
    return both.select("doc_id", "y_pred").join(sums, "doc_id")


@query("highlight_network", f"SELECT doc_id, '#16ce10' AS color, n AS marks FROM ({_MARKED}) JOIN (SELECT doc_id, len(words) + 1 AS n FROM v_words) USING (doc_id)")
def highlight_network(spark, d):
    """The tokens that decide a label get the colour of the greatest score."""
    rows, size = _decided_docs(spark, d)
    model = _network(spark, d)
    colored = explain.color_lists(explain.token_scores(rows, "doc_id", "ids", model.vectors(spark), model.weights(spark), model.dim))
    marks = explain.explode_scores(colored, "doc_id", "ids", None, "colors").where(F.col("token_id") >= size - K)
    return marks.groupBy("doc_id", F.col("colors").alias("color")).agg(F.count(F.lit(1)).alias("marks"))


@query("explain_model", f"SELECT doc_id, y AS y_pred, true AS adds_up FROM ({_MARKED})")
def explain_model(spark, d):
    """Scores of the tokens and the intercept add up to the logit of the predicted class, in every document."""
    rows, size = _marked_docs(spark, d)
    model = models.fit_classifier(rows, "ids", "y", size, reg=0.001)
    scored = models.explain_model(rows, model, "ids", size)
    bias = F.get(F.array(*[F.lit(float(b)) for b in model.interceptVector]), F.col("y_pred"))
    gap = F.abs(scoring.array_sum(F.col("scores")) + bias - F.get("z", F.col("y_pred")))
    return scored.select("doc_id", "y_pred", (gap < 1e-6).alias("adds_up"))


@query("score_batches", _PADDED + """
    SELECT doc_id, round(list_sum(ids)::DOUBLE / len(ids), 9) AS mean_id,
           round(len(list_filter(ids, lambda i: i <> 0))::DOUBLE / len(ids), 9) AS filled FROM padded""")
def score_batches(spark, d):
    """A function of the caller's sees whole batches: what it gives depends on the length of the batch's longest row."""
    def means(ids, real):
        return np.stack((ids.sum(1) / ids.shape[1], real.sum(1) / ids.shape[1]), 1)

    placed = batches.bucket_batches(_docs(spark, d).select("doc_id", "ids"), "ids", "doc_id", views.BATCH, shuffle=False)
    scored = models.score_batches(placed, means, id="doc_id")
    return scored.select("doc_id", *[F.round(F.get("z", F.lit(i)), 9).alias(c) for i, c in enumerate(("mean_id", "filled"))])


@query("fit_epochs_table")
def fit_epochs_table(spark, d):
    train, valid = sampling.balanced_train_input(_train_rows(spark, d), "y", "row_id", 0.2, 1, under=True)
    placed = batches.bucket_batches(valid, "ids", "row_id", views.BATCH, shuffle=True, seed=1)
    return models.fit_epochs_table(train, placed, "ids", "y", VOCAB_SIZE, K)


EPOCHS = 10


@query("fit_epochs_best", f"""
    SELECT run, {EPOCHS} AS epochs, y AS y_true, y AS y_pred, count(*) AS n
    FROM ({_MARKED}), (VALUES ('cross_entropy'), ('ordinal')) r(run) GROUP BY run, y""")
def fit_epochs_best(spark, d):
    """Ten epochs of each loss; the best model of each is loaded and tells all rows apart."""
    rows, size = _decided_docs(spark, d)
    placed = batches.bucket_batches(rows, "ids", "doc_id", views.BATCH, shuffle=False)
    path = scratch_path(spark, "epochs")
    runs = models.fit_epochs_table(rows, placed, "ids", "y", size, K, EPOCHS, out_dir=path)
    count = runs.groupBy("run").agg(F.count(F.lit(1)).cast("int").alias("epochs"))
    found = None
    for loss in network.LOSSES:
        scored = network.apply(rows, network.load(spark, f"{path}/{loss}/best"), "ids")
        cells = scored.groupBy(F.col("y").alias("y_true"), "y_pred").agg(F.count(F.lit(1)).alias("n")).withColumn("run", F.lit(loss))
        found = cells if found is None else found.unionByName(cells)
    return found.join(F.broadcast(count), "run").select("run", "epochs", "y_true", "y_pred", "n")


@query("best_by_metric", """
    SELECT run, epoch, accuracy FROM v_runs WHERE accuracy > 0
    QUALIFY row_number() OVER (PARTITION BY run ORDER BY accuracy DESC, epoch) = 1""")
def best_by_metric(spark, d):
    return models.best_by_metric(views.runs(spark, d), "accuracy")


@query("best_so_far", """
    SELECT run, epoch, accuracy, best_before, accuracy > best_before AS is_best FROM (
        SELECT *, coalesce(max(accuracy) OVER (PARTITION BY run ORDER BY epoch
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS best_before FROM v_runs)""")
def best_so_far(spark, d):
    return models.best_so_far(views.runs(spark, d), "accuracy")


# ---------------------------------------------------------------- metrics

def _pred(spark, d, lowest=0):
    return views.predictions(spark, d, lowest)


def _cm(spark, d, lowest=0):
    return metrics.confusion_counts(_pred(spark, d, lowest), K)


@query("confusion_counts", "SELECT y_true::INT AS y_true, y_pred::INT AS y_pred, n FROM v_cm")
def confusion_counts(spark, d):
    return _cm(spark, d)


@query("confusion_normalized", """
    SELECT y_true::INT AS y_true, y_pred::INT AS y_pred,
           round(n::DOUBLE / nullif(sum(n) OVER (PARTITION BY y_true), 0)::DOUBLE, 6) AS share FROM v_cm""")
def confusion_normalized(spark, d):
    return metrics.confusion_normalized(_cm(spark, d)).withColumn("share", F.round("share", 6))


@query("confusion_wide", "SELECT y_true::INT AS y_true, "
       + ", ".join(f"max(CASE WHEN y_pred = {j} THEN n END) AS pred_{j}" for j in range(K))
       + " FROM v_cm GROUP BY y_true")
def confusion_wide(spark, d):
    return metrics.confusion_wide(_cm(spark, d), K)


@query("per_class_accuracy", """
    SELECT class::INT AS class, correct, total, round(100 * correct::DOUBLE / nullif(total, 0), 6) AS accuracy,
           correct || ' / ' || total AS ratio FROM v_class_table""")
def per_class_accuracy(spark, d):
    return metrics.per_class_accuracy(_cm(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


@query("accuracy", """
    SELECT round(100.0::DOUBLE * sum(correct) / any_value(all_rows), 6) AS accuracy_exact,
           round(100.0::DOUBLE * sum(correct) / (ceil(any_value(all_rows) / 16.0) * 16), 6) AS accuracy_batched
    FROM v_class_table""")
def accuracy(spark, d):
    return metrics.accuracy(_pred(spark, d)).select(
        F.round("accuracy_exact", 6).alias("accuracy_exact"), F.round("accuracy_batched", 6).alias("accuracy_batched")
    )


def _prf(cm: str, p_base: str, r_base: str) -> str:
    return f"""
    WITH sums AS (
        SELECT t.class, t.correct, t.total, p.predicted, a.all_rows
        FROM (SELECT y_true AS class, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END)::BIGINT AS correct,
                     sum(n)::BIGINT AS total FROM {cm} GROUP BY y_true) t
        JOIN (SELECT y_pred AS class, sum(n) AS predicted FROM {cm} GROUP BY y_pred) p ON p.class = t.class,
             (SELECT sum(n) AS all_rows FROM {cm} ) a),
    pr AS (SELECT *, correct::DOUBLE / nullif({p_base}, 0)::DOUBLE AS precision,
                  correct::DOUBLE / nullif({r_base}, 0)::DOUBLE AS recall FROM sums),
    prf AS (SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM pr)
    """


_PRF_ROWS = """
    SELECT class::INT AS class, correct, total, round(precision, 6) AS precision, round(recall, 6) AS recall,
           round(f1, 6) AS f1 FROM prf"""
_REFERENCE, _REFERENCE_NO0 = (_prf(cm, "total", "all_rows") for cm in ("v_cm", "v_cm_no0"))


def _rounded(df):
    return df.select("class", "correct", "total", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("precision_recall_f1", _REFERENCE + _PRF_ROWS)
def precision_recall_f1(spark, d):
    return _rounded(metrics.precision_recall_f1(_cm(spark, d)))


@query("precision_recall_f1_missing_class", _REFERENCE_NO0 + _PRF_ROWS)
def precision_recall_f1_missing_class(spark, d):
    return _rounded(metrics.precision_recall_f1(_cm(spark, d, 1)))


@query("precision_recall_f1_standard", _prf("v_cm", "predicted", "total") + _PRF_ROWS)
def precision_recall_f1_standard(spark, d):
    return _rounded(metrics.precision_recall_f1(_cm(spark, d), mode="standard"))


@query("macro_f1_harmonic", _REFERENCE + "SELECT round(count(*) / sum(1 / f1), 6) AS f1 FROM prf")
def macro_f1_harmonic(spark, d):
    return metrics.macro_f1_harmonic(_cm(spark, d)).select(F.round("f1", 6).alias("f1"))


@query("macro_f1_harmonic_missing_class", _REFERENCE_NO0 + "SELECT round(count(*) / sum(1 / f1), 6) AS f1 FROM prf")
def macro_f1_harmonic_missing_class(spark, d):
    return metrics.macro_f1_harmonic(_cm(spark, d, 1)).select(F.round("f1", 6).alias("f1"))


@query("metrics_report", _REFERENCE + """
    SELECT round(100.0::DOUBLE * sum(correct) / (ceil(any_value(all_rows) / 16.0) * 16), 6) AS accuracy,
           round(count(*) / sum(1 / f1), 6) AS f1 FROM prf""")
def metrics_report(spark, d):
    report = metrics.metrics_report(_pred(spark, d), K)
    return report.select(F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"))


@query("class_report", _REFERENCE + """
    SELECT (class + 1)::INT AS class, round(precision, 2) AS precision, round(recall, 2) AS recall, round(f1, 2) AS f1,
           correct, total FROM prf""")
def class_report(spark, d):
    return metrics.class_report(_cm(spark, d))


_RUNNING = f"""
    WITH batches AS (
        SELECT batch_id, sum(CASE WHEN y_true = list_position(z, list_max(z)) - 1 THEN 1 ELSE 0 END) AS c, avg({_NLL}) AS l
        FROM v_logits GROUP BY batch_id),
    running AS (
        SELECT batch_id, (sum(c) OVER (ORDER BY batch_id))::BIGINT AS correct, sum(l) OVER (ORDER BY batch_id) AS loss
        FROM batches)
"""


def _running(spark, d):
    pred = scoring.predict_argmax(views.logits(spark, d))
    rows = metrics.running_metrics(pred, loss=metrics.row_loss("cross_entropy", "z", "y_true"))
    return rows.select("batch_id", "correct", *[F.round(c, 6).alias(c) for c in ("loss", "accuracy", "mean_loss")])


_RUNNING_ROWS = """
    SELECT batch_id, correct, round(loss, 6) AS loss, round(100.0::DOUBLE * correct / ((batch_id + 1) * 16), 6) AS accuracy,
           round(loss / ((batch_id + 1) * 16), 6) AS mean_loss FROM running"""


@query("running_metrics", _RUNNING + _RUNNING_ROWS)
def running_metrics(spark, d):
    return _running(spark, d)


@query("metric_every_n_steps", _RUNNING + _RUNNING_ROWS + " WHERE batch_id % 10 = 0 AND batch_id > 0")
def metric_every_n_steps(spark, d):
    return metrics.metric_every_n_steps(_running(spark, d), 10, "batch_id", skip_first=True)


@query("running_confusion_stream", "SELECT y_true::INT AS y_true, y_pred::INT AS y_pred, n FROM v_cm")
def confusion_stream(spark, d):
    path = scratch_path(spark, "predictions")
    _pred(spark, d).select("row_id", "y_true", "y_pred").repartition(4).write.parquet(path)
    stream = (
        spark.readStream.schema("row_id bigint, y_true int, y_pred int")
        .option("maxFilesPerTrigger", 2).parquet(path)
    )
    return running_confusion_stream(stream, K)


_HIT = "y_true = list_position(z, list_max(z)) - 1"


@query("running_metrics_stream", f"""
    WITH batches AS (
        SELECT row_id % 3 AS run, batch_id, avg({_NLL}) AS l, count(*) AS n,
               {', '.join(f"sum(CASE WHEN y_true = {c} THEN 1 ELSE 0 END) AS t{c}, sum(CASE WHEN {_HIT} AND y_true = {c} THEN 1 ELSE 0 END) AS h{c}"
                          for c in range(K))}
        FROM v_logits GROUP BY 1, 2),
    running AS (
        SELECT run, batch_id, sum(l) OVER w AS loss, sum(n) OVER w AS n,
               {', '.join(f"sum(t{c}) OVER w AS t{c}, sum(h{c}) OVER w AS h{c}" for c in range(K))}
        FROM batches WINDOW w AS (PARTITION BY run ORDER BY batch_id)),
    sums AS (
        SELECT *, {' + '.join(f'h{c}' for c in range(K))} AS hits,
               {' + '.join(f"(CASE WHEN h{c} > 0 THEN (n + t{c}) / (2.0::DOUBLE * h{c}) ELSE 0.0::DOUBLE END)" for c in range(K))} AS inverse
        FROM running)
    SELECT run::VARCHAR AS run, batch_id::BIGINT AS batch_id, hits::BIGINT AS correct, round(loss, 6) AS loss,
           round(100.0::DOUBLE * hits / ((batch_id + 1) * 16), 6) AS accuracy, round(loss / ((batch_id + 1) * 16), 6) AS mean_loss,
           round(CASE WHEN hits > 0 THEN {K} / inverse ELSE 'inf'::DOUBLE END, 6) AS f1
    FROM sums""")
def metrics_stream(spark, d):
    """Batches of three runs; their files are in no order, and every fifth batch arrives twice."""
    path = scratch_path(spark, "batches")
    pred = scoring.predict_argmax(views.logits(spark, d)).withColumn("_loss", metrics.row_loss("cross_entropy", "z", "y_true"))
    rows = F.collect_list(F.struct("y_true", "y_pred"))  # 16 rows at most
    batches = pred.groupBy((F.col("row_id") % 3).cast("string").alias("run"), F.col("batch_id").cast("bigint").alias("batch_id")).agg(
        rows.alias("rows"), F.avg("_loss").alias("loss"))
    batches = via_table(batches.select(
        "run", "batch_id", *[F.col(f"rows.{c}").cast("array<int>").alias(c) for c in ("y_true", "y_pred")], "loss"), "batches")
    for part in (batches.where("batch_id % 5 = 0"), batches):
        part.repartition(4, F.xxhash64("batch_id")).write.mode("append").parquet(path)
    stream = spark.readStream.schema(batches.schema).option("maxFilesPerTrigger", 3).parquet(path)
    running = running_metrics_stream(stream, K)
    return running.select("run", "batch_id", "correct", *[F.round(c, 6).alias(c) for c in ("loss", "accuracy", "mean_loss", "f1")])


# ---------------------------------------------------------------- explanations

def _scored(spark, d, steps=None):
    return explain.token_scores(_docs(spark, d), "doc_id", "ids", views.vectors(spark, d), views.class_weight(spark, d), DIM, steps)


def _rounded_lists(spark, d):
    """Scores are rounded before they are coloured, as their last bit may decide the palette place."""
    return _scored(spark, d).withColumn("scores", F.transform("scores", lambda s: F.round(s, 12)))


def _score_rows(scored):
    rows = explain.explode_scores(scored, "doc_id", "ids", "words")
    return rows.select("doc_id", "pos", F.col("token_id").alias("id"), "token", F.round("score", 12).alias("score"))


@query("ig_scores", "SELECT doc_id, pos::INT AS pos, id::INT AS id, token, round(score, 12) AS score FROM v_scores")
def ig_scores(spark, d):
    return _score_rows(_scored(spark, d))


def _path_sql() -> str:
    at, weight = np.polynomial.legendre.leggauss(explain.PATH_STEPS)
    nodes = ", ".join(f"({(a + 1) / 2!r}::DOUBLE, {w / 2!r}::DOUBLE)" for a, w in zip(at.tolist(), weight.tolist()))
    return f"""
    WITH path(a, wt) AS (VALUES {nodes}),
    slopes AS (SELECT doc_id, d, any_value(t) AS t, sum(wt * (1 - pow(tanh(a * m), 2))) AS s
               FROM v_pooled, path GROUP BY doc_id, d),
    factors AS (SELECT p.doc_id, p.d, c.w * p.s / p.t / 64 AS f
                FROM slopes p JOIN v_doc_pred y USING (doc_id) JOIN v_class_dims c ON c.class = y.class AND c.d = p.d),
    pair_scores AS (SELECT doc_id, id, sum(x * f) AS score
                    FROM v_counts JOIN v_dims USING (id) JOIN factors USING (doc_id, d) GROUP BY doc_id, id)
    SELECT t.doc_id, t.pos::INT AS pos, t.id::INT AS id, t.token, round(s.score, 12) AS score
    FROM v_tokens t JOIN pair_scores s ON t.doc_id = s.doc_id AND t.id = s.id"""


@query("ig_scores_numeric", _path_sql())
def ig_scores_numeric(spark, d):
    return _score_rows(_scored(spark, d, explain.PATH_STEPS))


def mean_pool_network(w: np.ndarray, b: np.ndarray):
    """The mean-pool network as a caller's function of padded vectors: logits, and the gradient of the target's logit."""
    def network(x: np.ndarray, mask: np.ndarray, target: np.ndarray | None):
        real = mask.astype(float)
        n = real.sum(axis=1)[:, None]
        hidden = np.tanh((real[:, None, :] @ x)[:, 0] / n)
        if target is None:
            return hidden @ w.T + b, None
        slope = (w[target] * (1 - hidden ** 2) / n)[:, None, :]
        return hidden @ w.T + b, np.broadcast_to(slope, x.shape) if mask.all() else slope * real[:, :, None]

    return network


def _scored_by_network(spark, d):
    classes = views.class_weight(spark, d).toPandas().sort_values("class")  # a row a class
    network = mean_pool_network(np.stack(classes["w"].to_numpy()).astype(float), classes["b"].to_numpy(float))
    return explain.network_scores(_docs(spark, d), "ids", views.vectors(spark, d), network, DIM)


@query("ig_scores_network", "SELECT doc_id, pos::INT AS pos, id::INT AS id, token, round(score, 9) AS score FROM v_scores")
def ig_scores_network(spark, d):
    """A network that the library knows nothing of but its logits and gradients; here it is the one with a closed form."""
    rows = explain.explode_scores(_scored_by_network(spark, d), "doc_id", "ids", "words")
    return rows.select("doc_id", "pos", F.col("token_id").alias("id"), "token", F.round("score", 9).alias("score"))


@query("ig_network_completeness", """
    SELECT s.doc_id, round(sum(score) * 64, 6) AS attributed, round(any_value(y.logit) - any_value(c.b), 6) AS gain
    FROM v_scores s JOIN v_doc_pred y USING (doc_id) JOIN v_class_weight c ON c.class = y.class GROUP BY s.doc_id""")
def ig_network_completeness(spark, d):
    both = explain.network_completeness(_scored_by_network(spark, d), "doc_id", DIM)
    return both.select("doc_id", F.round("attributed", 6).alias("attributed"), F.round("gain", 6).alias("gain"))


@query("ig_completeness", """
    SELECT s.doc_id, round(sum(score) * 64, 9) AS attributed, round(any_value(y.logit) - any_value(c.b), 9) AS gain
    FROM v_scores s JOIN v_doc_pred y USING (doc_id) JOIN v_class_weight c ON c.class = y.class GROUP BY s.doc_id""")
def ig_completeness(spark, d):
    both = explain.ig_completeness(_scored(spark, d), "doc_id", views.class_weight(spark, d), DIM)
    return both.select("doc_id", F.round("attributed", 9).alias("attributed"), F.round("gain", 9).alias("gain"))


@query("score_bounds", """
    SELECT doc_id, round(min(score), 12) AS low, round(median(score), 12) AS mid, round(max(score), 12) AS high
    FROM v_scores GROUP BY doc_id""")
def score_bounds(spark, d):
    bounds = explain.bound_lists(_scored(spark, d)).where(F.col("mid").isNotNull())
    return bounds.select("doc_id", *[F.round(c, 12).alias(c) for c in ("low", "mid", "high")])


def _shade_sql() -> str:
    def channel(red: int, white: int, green: int) -> str:
        return (
            f"(CASE WHEN place <= 0 THEN {red}.0::DOUBLE WHEN place >= 1 THEN {green}.0::DOUBLE "
            f"WHEN place <= center THEN {red} + ({white} - {red}) * place / center "
            f"ELSE {white} + ({green} - {white}) * (place - center) / (1 - center) END)"
        )

    three = [channel(*c) for c in zip(explain.RED, explain.WHITE, explain.GREEN)]
    shades = ", ".join(f"round_even({c}, 0)::INT AS c{i}" for i, c in enumerate(three))
    return f"""
    WITH rounded AS (SELECT doc_id, pos, round(score, 12) AS score FROM v_scores ),
    bounds AS (SELECT doc_id, min(score) AS low, median(score) AS mid, max(score) AS high FROM rounded GROUP BY doc_id),
    places AS (
        SELECT s.doc_id, s.pos, high > low AS spread, (mid - low) / nullif(high - low, 0) AS center,
               least(floor((score - low) / nullif(high - low, 0) * 256), 255) / 255.0::DOUBLE AS place
        FROM rounded s JOIN bounds USING (doc_id)),
    shades AS (SELECT doc_id, pos, spread, {shades} FROM places)
    SELECT doc_id, pos::INT AS pos,
           CASE WHEN spread THEN format('#{{:02x}}{{:02x}}{{:02x}}', c0, c1, c2) ELSE '#ffffff' END AS color FROM shades"""


@query("score_colors", _shade_sql())
def score_colors(spark, d):
    return explain.color_lists(_rounded_lists(spark, d)).select("doc_id", F.posexplode("colors").alias("pos", "color"))


def _explain_input(spark, d):
    return encoded_reviews(spark, d), views.vocabulary_vectors(spark, d, VOCAB_SIZE), views.class_weight(spark, d)


@query("highlight_html")
def highlight_html(spark, d):
    docs, vecs, weights = _explain_input(spark, d)
    colored = explain.color_lists(explain.token_scores(docs, "row_id", "ids", vecs, weights, DIM))
    return explain.highlight_lists(colored, "reviewText").select("row_id", "html")


def _escaped(expr: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        expr = f"replace({expr}, '{raw}', '{safe}')"
    return expr


_HTML = _shade_sql().replace("\n    SELECT doc_id, pos::INT AS pos,", ",\n    colors AS (SELECT doc_id, pos,", 1) + f""")
    SELECT p.doc_id, string_agg(
        CASE WHEN g THEN {_escaped('p')}
             ELSE '<mark style="margin: 0; padding: 0; background-color:' || color || '">' || {_escaped('p')} || '</mark>' END,
        '' ORDER BY i) AS html
    FROM v_pieces p LEFT JOIN colors c ON c.doc_id = p.doc_id AND c.pos = p.pos AND NOT g GROUP BY p.doc_id"""


@query("highlight_html_words", _HTML)
def highlight_html_words(spark, d):
    """The same marks around words, whose ids are a hash instead of a vocabulary."""
    texts = views.documents(spark, d).select("doc_id", "text")
    docs = _rounded_lists(spark, d).join(pretoken_spans(texts, "text"), "doc_id")
    colored = explain.color_lists(docs.withColumnRenamed("words", "tokens"))
    return explain.highlight_lists(colored, "text").select("doc_id", "html")


@query("prediction_vs_actual", """
    SELECT r.row_id, (y.class + 1)::INT AS pred, r.overall AS actual FROM v_doc_pred y JOIN v_reviews r ON r.row_id = y.doc_id""")
def prediction_vs_actual(spark, d):
    scored = scoring.dan_logit_arrays(_pooled(spark, d), views.class_weight(spark, d))
    pred = scoring.predict_argmax(scored).select(F.col("doc_id").alias("row_id"), "y_pred")
    return metrics.prediction_vs_actual(pred, views.reviews(spark, d), "row_id", "overall")


@query("explain_sample")
def explain_sample(spark, d):
    vocab, merges = trained(spark, d)
    return explain.explain_sample(
        views.review_corpus(spark, d), vocab, merges, views.vocabulary_vectors(spark, d, VOCAB_SIZE), views.class_weight(spark, d), DIM,
        n=5, seed=1, length=[0, 6000],
    )
