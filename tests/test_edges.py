"""Rows that are easy to lose or to read wrongly."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from textscore.corpus import reviews_corpus
from textscore.operators import batches, clean, labels, metrics, profile, sampling, scoring
from textscore.operators.selection import column_order, keep_first
from textscore.streaming.running import running_confusion_stream


def test_whole_numbers_keep_every_digit(spark):
    given = ["9007199254740993", " 12 ", "+7", "-3", "4.0", "1e3", ".5", "3d", "3f", "x1", "", "9" * 25, None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    got = [r["n"] for r in rows.select("i", clean.to_whole_number(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got[:10] == [9007199254740993, 12, 7, -3, 4, 1000, None, None, None, None] and got[10] is None and got[12] is None


def test_a_cut_between_equal_keys_fails(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "d")], "k int, x string")
    with pytest.raises(PySparkException, match="not unique"):
        keep_first(rows, [], column_order(rows, "k"), 2).collect()
    assert keep_first(rows, [], column_order(rows, "k"), 3).count() == 3
    with pytest.raises(PySparkException, match="not unique"):
        sampling.sample_n(rows.where("k = 1"), 1, "k").collect()


def test_a_category_named_like_the_total(spark):
    c = reviews_corpus(spark.createDataFrame([(1, "a b", "all", 1), (2, "c", "x", 2)], "row_id int, reviewText string, type string, overall int"))
    assert sorted((r["dataset"], r["n_rows"], r["unique_words"]) for r in profile.corpus_summary(c).collect()) == [("all", 1, 2), ("all", 2, 3), ("x", 1, 1)]


def test_missing_scores_and_groups_without_range_are_class_zero(spark):
    rows = spark.createDataFrame([(1, 5), (1, None), (2, 3), (2, 3), (3, 1), (3, 9)], "g int, s int")
    assert sorted(r["s"] for r in labels.binarize_label(rows, "s").collect()) == [0, 0, 0, 0, 1, 1]
    assert sorted((r["g"], r["label"]) for r in labels.standardize_binarize(rows, "s", "g").collect()) == [(1, 0), (1, 0), (2, 0), (2, 0), (3, 0), (3, 1)]


@pytest.mark.parametrize("numbers", [0, 10 ** 9])
def test_a_token_without_vector_fails(spark, monkeypatch, numbers):
    monkeypatch.setattr(scoring, "VECTOR_NUMBERS", numbers)
    vecs = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "token_id int, v array<float>")
    docs = spark.createDataFrame([(7, [0, 1, 1])], "doc_id int, ids array<int>")
    assert scoring.mean_pool(docs, "doc_id", "ids", vecs, 2).first()["n_tokens"] == 3
    docs = spark.createDataFrame([(7, [0, 1, 5])], "doc_id int, ids array<int>")
    with pytest.raises(PySparkException, match="no vector"):
        scoring.mean_pool(docs, "doc_id", "ids", vecs, 2).collect()


@pytest.mark.parametrize("pair", [(0, 7), (None, 1), (-1, 0)])
def test_a_label_outside_the_classes_fails(spark, pair):
    rows = spark.createDataFrame([(0, 1), (1, 1), pair], "y_true int, y_pred int")
    with pytest.raises(PySparkException, match="no class"):
        metrics.confusion_counts(rows, 2).collect()
    assert sum(r["n"] for r in metrics.confusion_counts(rows.limit(2), 2).collect()) == 2


def test_rows_without_ids_stay_in_their_batch(spark):
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else list(range(i % 3))) for i in range(12)], "id int, ids array<int>")
    placed = batches.bucket_batches(rows, "ids", "id", 4, shuffle=False)
    assert placed.count() == 12 and sorted(r["pos"] for r in placed.collect()) == list(range(12))
    assert all(r["ids"] is not None for r in batches.pad_to_batch_max(placed, "ids").collect())


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, kept = str(tmp_path / "in"), str(tmp_path / "kept")
    schema = "row_id bigint, y_true int, y_pred int"

    def arrive(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)

    def run():
        cells = running_confusion_stream(spark.readStream.schema(schema).parquet(source), 2, kept)
        return {(r["y_true"], r["y_pred"]): r["n"] for r in cells.collect()}

    arrive([(1, 0, 0), (2, 0, 1)])
    assert run() == {(0, 0): 1, (0, 1): 1, (1, 0): 0, (1, 1): 0}
    arrive([(3, 1, 1)])
    assert run() == {(0, 0): 1, (0, 1): 1, (1, 0): 0, (1, 1): 1}
    assert run()[1, 1] == 1


def test_scratch_tables_are_deleted_on_request(spark, monkeypatch):
    import os

    from textscore import session

    monkeypatch.setattr(session, "_paths", [])
    monkeypatch.setattr(session, "_made", {})
    kept = session.via_table(spark.range(5), "numbers")
    path = session._paths[-1].removeprefix("file:")
    assert os.path.exists(path) and kept.count() == 5
    made = session.made_once(spark, ("x",), lambda: 1)
    assert session.made_once(spark, ("x",), lambda: 2) == made == 1
    assert session.clear_scratch(spark) == 1 and not os.path.exists(path)
    assert session.made_once(spark, ("x",), lambda: 2) == 2
