import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textscore.operators import batches, metrics, models


@pytest.fixture(scope="module")
def docs(spark):
    n = F.when(F.col("id") % 3 == 0, 4).otherwise(F.col("id") % 9)
    ids = F.transform(F.sequence(F.lit(0), n), lambda i: (i + 1).cast("int"))
    return spark.range(107, numPartitions=4).withColumn("ids", F.slice(ids, 1, n)).cache()


def order_of(docs):
    return [r.id for r in sorted(docs.collect(), key=lambda r: (len(r.ids), r.id))]


def test_length_order_is_stable(docs):
    got = sorted((r.pos, r.id) for r in batches.length_order(docs, "ids", "id").collect())
    assert [i for _, i in got] == order_of(docs) and [p for p, _ in got] == list(range(107))


def test_shuffled_batches_drop_the_tail(docs):
    rows = batches.bucket_batches(docs, "ids", "id", 16, shuffle=True, seed=1).collect()
    want = order_of(docs)
    assert len(rows) == 96 and Counter(r.batch_id for r in rows) == {b: 16 for b in range(6)}
    assert all(want.index(r.id) // 16 == r.batch_id for r in rows)
    keys = {r.batch_id: r.batch_key for r in rows}
    assert sorted(keys, key=keys.get) != list(range(6))
    kept = batches.bucket_batches(docs, "ids", "id", 16, shuffle=True, drop_tail=False)
    assert kept.count() == 107


def test_batches_in_order_keep_the_tail(docs):
    rows = batches.bucket_batches(docs, "ids", "id", 16, shuffle=False).collect()
    assert len(rows) == 107 and max(r.batch_id for r in rows) == 6
    keys = {r.batch_id: r.batch_key for r in rows}
    assert sorted(keys, key=keys.get) == list(range(7))
    assert tuple(batches.batch_count(docs, 16).first()) == (7, 6)


def test_padding_is_equal_in_a_batch(docs):
    placed = batches.bucket_batches(docs, "ids", "id", 16, shuffle=False)
    sizes = {}
    for r in batches.padding_mask(batches.pad_to_batch_max(placed, "ids"), "ids").collect():
        sizes.setdefault(r.batch_id, set()).add(len(r.ids))
        assert r.ids[:r.n_tokens] == list(range(1, r.n_tokens + 1)) and not any(r.ids[r.n_tokens:])
        assert r["mask"] == [i == 0 for i in r.ids]
    assert all(len(s) == 1 for s in sizes.values())


# ---------------------------------------------------------------- metrics

def predictions(spark, pairs, batch_size=2):
    rows = [(i, t, p, i // batch_size) for i, (t, p) in enumerate(pairs)]
    return spark.createDataFrame(rows, "row_id int, y_true int, y_pred int, batch_id bigint")


PAIRS = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 0), (2, 2), (2, 2)]


def plain(pairs, k):
    m = np.zeros((k, k))
    for t, p in pairs:
        m[t, p] += 1
    hits, rows = m.diagonal(), m.sum(axis=1)
    with np.errstate(all="ignore"):
        precision, recall = hits / rows, hits / rows.sum()
        f1 = 2 * precision * recall / (precision + recall)
        ok = f1[~np.isnan(f1)]
        return m, precision, recall, f1, k / np.sum(1 / ok) if len(ok) else math.inf


def nan(v):
    return math.nan if v is None else v


@pytest.mark.parametrize("pairs,k", [(PAIRS, 3), (PAIRS, 4), ([(0, 1), (1, 0)], 2), ([(0, 0), (1, 0), (1, 0)], 2)])
def test_metrics_equal_plain_arrays(spark, pairs, k):
    pred = predictions(spark, pairs)
    cm = metrics.confusion_counts(pred, k).cache()
    m, precision, recall, f1, macro = plain(pairs, k)
    assert {(r.y_true, r.y_pred): r.n for r in cm.collect()} == {(i, j): m[i, j] for i in range(k) for j in range(k)}
    rows = metrics.precision_recall_f1(cm).orderBy("class").collect()
    for name, want in (("precision", precision), ("recall", recall), ("f1", f1)):
        np.testing.assert_allclose([nan(r[name]) for r in rows], want)
    assert metrics.macro_f1_harmonic(cm).first()[0] == pytest.approx(macro)
    report = metrics.metrics_report(pred, k, 2).first()
    full = math.ceil(len(pairs) / 2) * 2
    assert report.f1 == pytest.approx(macro) and report.accuracy == pytest.approx(100 * np.trace(m) / full)
    exact = metrics.accuracy(pred, 2).first()
    assert exact.accuracy_exact == pytest.approx(100 * np.trace(m) / len(pairs))
    assert exact.accuracy_batched == pytest.approx(report.accuracy)
    wide = metrics.confusion_wide(cm, k).orderBy("y_true").collect()
    assert [[r[f"pred_{j}"] for j in range(k)] for r in wide] == m.tolist()


def test_class_without_rows_has_no_share(spark):
    cm = metrics.confusion_counts(predictions(spark, PAIRS), 4)
    shares = {(r.y_true, r.y_pred): r.share for r in metrics.confusion_normalized(cm).collect()}
    assert shares[3, 0] is None and shares[0, 1] == 0.5
    rows = {r["class"]: r for r in metrics.per_class_accuracy(cm).collect()}
    assert rows[2].ratio == "2 / 3" and rows[3].accuracy is None and rows[3].ratio == "0 / 0"


def test_standard_precision_uses_predicted_rows(spark):
    cm = metrics.confusion_counts(predictions(spark, PAIRS), 3)
    rows = {r["class"]: r for r in metrics.precision_recall_f1(cm, "standard").collect()}
    assert rows[1].precision == pytest.approx(2 / 3) and rows[1].recall == 1
    with pytest.raises(ValueError):
        metrics.precision_recall_f1(cm, "other")


def test_running_metrics_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(metrics, "RUN_BLOCK", 2)
    rng = np.random.default_rng(0)
    pairs = [tuple(map(int, rng.integers(0, 3, 2))) for _ in range(23)]
    pred = predictions(spark, pairs, 4).withColumn("l", F.col("row_id") * 0.5)
    rows = metrics.running_metrics(pred, 4, loss=F.col("l")).orderBy("batch_id").collect()
    correct = loss = 0
    for b, r in enumerate(rows):
        part = range(4 * b, min(4 * b + 4, 23))
        correct += sum(pairs[i][0] == pairs[i][1] for i in part)
        loss += sum(0.5 * i for i in part) / len(part)
        assert (r.correct, r.loss) == (correct, pytest.approx(loss))
        assert r.accuracy == pytest.approx(100 * correct / (4 * (b + 1)))


def test_metric_every_n_steps(spark):
    log = spark.range(10).withColumnRenamed("id", "step")
    assert [r.step for r in metrics.metric_every_n_steps(log, 4).collect()] == [0, 4, 8]
    assert [r.step for r in metrics.metric_every_n_steps(log, 4, skip_first=True).collect()] == [4, 8]


RUNS = [
    ("a", 0, 0.0), ("a", 1, 3.0), ("a", 2, 3.0), ("a", 3, 1.0), ("b", 0, float("nan")), ("b", 1, 2.0),
    ("c", 0, 0.0), ("d", 0, None), ("d", 1, float("nan")),
]


def test_best_by_metric(spark):
    runs = spark.createDataFrame(RUNS, "run string, epoch int, f1 double")
    got = sorted(tuple(r) for r in models.best_by_metric(runs, "f1").collect())
    assert got == [("a", 1, 3.0), ("b", 1, 2.0)]
    marks = {(r.run, r.epoch) for r in models.best_so_far(runs, "f1").collect() if r.is_best}
    assert marks == {("a", 1), ("b", 1)}
