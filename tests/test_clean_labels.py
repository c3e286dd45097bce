import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textscore.functions.text import lower_by_char, separate_tags, split_blanks
from textscore.operators import clean, labels


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).first()[0]


def test_null_tokens_only_whole_cells(spark):
    df = spark.createDataFrame([("", "a"), ("<NA>", "<NA> b"), ("x", "")], "a string, b string")
    assert [tuple(r) for r in clean.null_tokens(df).collect()] == [(None, "a"), (None, "<NA> b"), ("x", None)]


@pytest.mark.parametrize("text,number", [
    ("3", 3), ("3.0", 3), (" 7 ", 7), ("x1", None), ("", None), ("3.7", None), ("-2", -2), ("1e2", 100), (None, None),
])
def test_coerce_numeric(spark, text, number):
    df = spark.createDataFrame([(text, "keep 1")], "n string, essay string")
    assert tuple(clean.coerce_numeric(df).first()) == (number, "keep 1")


def test_count_nonintegral(spark):
    df = spark.createDataFrame([("1.5",), ("2",), ("x",), ("0.25",)], "n string")
    assert clean.count_nonintegral(df, ["n"]).first()[0] == 2


def test_entity_tags_have_no_word_boundary(spark):
    assert one(spark, "@CAPS1 and @DRIVER@NUM2", separate_tags) == "@CAPS 1 and @DR IVER@NUM 2"


def test_split_blanks_keeps_empty_ends(spark):
    assert one(spark, " a  b ", split_blanks) == ["", "a", "b", ""]
    assert one(spark, "a b\x1cc d", split_blanks) == ["a", "b", "c", "d"]


def test_lower_has_no_final_sigma(spark):
    assert one(spark, "ΟΔΟΣ", lower_by_char) == "οδοσ"


def test_row_id_is_contiguous(spark):
    df = spark.range(0, 5000, 7).withColumnRenamed("id", "k").repartition(5)
    got = sorted((r.k, r.row_id) for r in clean.row_id(df, "k").collect())
    assert got == [(7 * i, i) for i in range(len(got))] and len(got) == 715


def test_string_guard_counts_rows_without_text(spark):
    df = spark.createDataFrame([("a", "xy"), ("a", None), ("b", None)], "g string, t string")
    got = {r.g: (r.n_rows, r.n_texts, r.n_chars) for r in clean.string_guard(df, "t", "g").collect()}
    assert got == {"a": (2, 1, 2), "b": (1, 0, 0)}


def test_union_sources_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3, "z")], "x int, w string")
    assert [tuple(r) for r in clean.union_sources(a, b).collect()] == [(1, 2, None), (3, None, "z")]


@pytest.mark.parametrize("edges", [(1, 7, 8, 9, 12), (0, 2, 3, 4, 6), (-1, 1, 2, 3, 4)])
def test_bin_edges_equal_pandas(spark, edges):
    values = list(range(-3, 15))
    df = spark.createDataFrame([(v,) for v in values], "v int")
    got = [r[0] for r in labels.bin_fixed_edges(df, "v", edges).orderBy("v").select("label").collect()]
    want = pd.cut(pd.Series(values), list(edges), labels=[1, 2, 3, 4])
    assert got == [None if pd.isna(w) else int(w) for w in want]


def test_bin_quantiles_equal_pandas(spark):
    rng = np.random.default_rng(0)
    values = rng.integers(2, 25, 400).tolist() + [7] * 200
    df = spark.createDataFrame([(v,) for v in values], "v int")
    got = [r.label for r in labels.bin_quantiles(df, "v", 4).orderBy("v").collect()]
    assert got == pd.qcut(pd.Series(sorted(values)), 4, labels=[1, 2, 3, 4]).astype(int).tolist()


def test_equal_quantiles_raise(spark):
    df = spark.createDataFrame([(1,)] * 10 + [(2,)], "v int")
    with pytest.raises(ValueError, match="unique"):
        labels.bin_quantiles(df, "v", 4)


def test_categorize_unknown_set_is_null(spark):
    rows = [(9, 3), (3, 2), (1, 7), (1, 8), (1, 1), (5, 0)]
    df = spark.createDataFrame(rows, "essay_set int, domain1_score int")
    plan = {k: v for k, v in labels.ESSAY_PLAN.items() if k < 7}
    got = [tuple(r) for r in labels.categorize_by_set(df, plan).collect()]
    assert got == [(9, None), (3, 3), (1, 1), (1, 2), (1, None), (5, 1)]


def test_standardize_group_without_range(spark):
    df = spark.createDataFrame([(1, 2), (1, 6), (1, 4), (2, 5)], "g int, s int")
    got = sorted((r.g, r.s, r.score_std) for r in labels.standardize_by_group(df, "s", "g").collect())
    assert got == [(1, 2, -1.0), (1, 4, 0.0), (1, 6, 1.0), (2, 5, None)]


def test_class_index_types(spark):
    df = spark.createDataFrame([(3,)], "s int")
    assert labels.class_index(df, "s").first().y == 2
    assert labels.class_index(df, "s", "binary").first().y == 3
    assert labels.class_index(df, "s", "standardized").schema["y"].dataType.simpleString() == "float"
    with pytest.raises(ValueError):
        labels.class_index(df, "s", "other")


def test_class_weights(spark):
    df = spark.createDataFrame([(1,)] * 3 + [(2,)], "y int")
    assert {r.y: r.weight for r in labels.class_weights(df, "y").collect()} == {1: 4 / 3, 2: 4.0}


def test_label_modes(spark):
    df = spark.createDataFrame([(5, 0), (5, 4), (5, 3)], "essay_set int, domain1_score int")
    got = {m: [r.domain1_score for r in labels.label_essays(df, score_type=m).collect()]
           for m in ("categorical", "standardized", "binary")}
    assert got == {"categorical": [1, 4, 3], "standardized": [-1.0, 1.0, 0.5], "binary": [0, 1, 1]}
    reviews = spark.createDataFrame([(4,), (5,)], "overall int")
    assert [r.overall for r in labels.label_reviews(reviews, score_type="binary").collect()] == [0, 1]
    with pytest.raises(NotImplementedError):
        labels.label_reviews(reviews, score_type="standardized")


def test_rows_without_a_group_are_scaled_too(spark):
    rows = spark.createDataFrame([(1, "a", 2), (2, "a", 6), (3, None, 1), (4, None, 3), (5, None, None), (6, "b", 7)], "id int, g string, s int")
    got = {r.id: (r.score_std, r.g) for r in labels.standardize_by_group(rows, "s", "g").collect()}
    assert got == {1: (-1.0, "a"), 2: (1.0, "a"), 3: (-1.0, None), 4: (1.0, None), 5: (None, None), 6: (None, "b")}
    assert {r.id: r.label for r in labels.standardize_binarize(rows, "s", "g").collect()} == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0, 6: 0}
    plan = labels.standardize_by_group(rows, "s", "g")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
