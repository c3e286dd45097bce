import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textscore.corpus import Corpus
from textscore.operators import profile

ROWS = [
    (1, " a  b ", 1, "x"), (2, "a\tb c", 5, "x"), (3, "@CAPS1 @@PERSON12 q@NUM1 @x @CAPS1,", 5, "y"),
    (4, "", 3, "y"), (5, None, 4, "y"), (6, "Éa \n b", 2, None),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus(spark.createDataFrame(ROWS, "id int, text string, score int, cat string"), "id", "text", "score", "cat")


def brute(rows):
    words, chars, length = set(), set(), 0
    for _, text, _, _ in rows:
        if isinstance(text, str):
            length += len(text)
            words.update(re.split(r"\s{1,}", text))
            chars.update(text)
    return len(rows), len(words), len(chars), length / len(rows), sum(r[2] for r in rows) / len(rows)


def test_corpus_summary_equals_plain_loop(corpus):
    got = {r.dataset: tuple(r)[1:] for r in profile.corpus_summary(corpus).collect()}
    want = {"all": brute(ROWS)} | {g: brute([r for r in ROWS if r[3] == g]) for g in ("x", "y")}
    assert set(got) == set(want)
    for g in want:
        assert got[g] == pytest.approx(want[g])


def test_score_counts_wide_fills_zero(corpus):
    got = {r.dataset: tuple(r[f"score_{i}"] for i in range(1, 6)) for r in profile.score_counts_wide(corpus).collect()}
    assert got == {"all": (1, 1, 1, 1, 2), "x": (1, 0, 0, 0, 1), "y": (0, 0, 1, 1, 1)}


def test_entity_tags(corpus):
    found = []
    for _, text, _, _ in ROWS:
        for token in re.split(r"\s{1,}", text or ""):
            hit = re.search("@+[A-Z]+[0-9]*", token) if token.startswith("@") else None
            if hit:
                found.append(hit.group(0))
    got = {r.tag: r.n for r in profile.entity_tag_counts(corpus.df, "text").collect()}
    assert got == Counter(found) == {"@CAPS1": 2, "@@PERSON12": 1}
    assert {r.tag_type for r in profile.entity_tag_types(corpus.df, "text").collect()} == {"@CAPS", "@@PERSON"}
    assert {r.word for r in profile.entity_words(corpus.df, "text").collect()} == {"@CAPS1", "@@PERSON12", "@x", "@CAPS1,"}


@pytest.mark.parametrize("values", [
    [1, 2, 3, 10], [5, 5, 5], list(range(24)), [0, 1, 2, 3, 4], [0.1 * i for i in range(31)],
    np.random.default_rng(1).normal(size=500).tolist(),
])
def test_histogram_equals_numpy(spark, values):
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    got = {r.bin: r.n for r in profile.histogram_by_group(df, "v", "g").collect()}
    counts, edges = np.histogram(values, 10)
    assert got == {i: int(n) for i, n in enumerate(counts) if n}


def test_describe_equals_pandas(spark):
    rows = [(1, 3, None), (1, 4, None), (1, 9, None), (2, 1, 5), (2, 2, None)]
    df = spark.createDataFrame(rows, "g int, a int, b int")
    got = {(r.g, r.column): tuple(r)[2:] for r in profile.describe_by_group(df, "g", ["a", "b"]).collect()}
    frame = pd.DataFrame(rows, columns=["g", "a", "b"])
    for (g, c), values in got.items():
        col = frame[frame.g == g][c].dropna()
        if col.empty:
            assert values == (None,) * 8
        else:
            want = [None if pd.isna(v) else v for v in col.describe()]
            assert values == pytest.approx(tuple(want))


def test_describe_report(spark):
    df = spark.createDataFrame([(1, 3), (1, 4), (2, 7)], "s int, a int")
    got = {r.metric: (r.set_1, r.set_2, r.set_3) for r in profile.describe_report(df, "s", ["a"], [1, 2, 3]).collect()}
    assert got == {"count": (2, 1, None), "mean": (3.5, 7, None), "min": (3, 7, None), "max": (4, 7, None)}


def test_approximate_unique_words(corpus):
    got = {r.dataset: r.unique_words for r in profile.unique_words(corpus, approx=True).collect()}
    assert got["x"] == 4


def test_sketches_of_growing_corpora(spark, tmp_path):
    from textscore.operators import sketches

    rng = np.random.default_rng(2)
    words = [f"w{i}é" for i in range(9000)]
    folder, read_paths = str(tmp_path / "sketches"), []
    schema = "file string, id int, text string, score double, cat string"
    rows = []
    for i in range(400):
        text = None if i % 50 == 7 else "" if i % 50 == 8 else " ".join(words[j] for j in (rng.exponential(2000, 60).astype(int) % 9000))
        score = None if i % 40 == 3 else float(int(rng.exponential(3) ** 3))
        rows.append((f"f{i % 4}", i, text, score, None if i % 10 == 9 else "one" if i % 3 else "two"))
    rows += rows[:20]
    for name in ("f0", "f1", "f2", "f3"):
        spark.createDataFrame([r for r in rows if r[0] == name], schema).coalesce(1).write.parquet(str(tmp_path / name))

    def read(paths):
        read_paths.append([p[-2:] for p in paths])
        found = spark.read.schema(schema).parquet(*paths).withColumn("file", F.concat(F.lit(f"{tmp_path}/"), "file"))
        return Corpus(found, "id", "text", "score", "cat")

    files = [str(tmp_path / name) for name in ("f0", "f1", "f2", "f3")]
    assert sketches.growing_summary(sketches.read_sketches(spark, folder)).collect() == []
    sketches.add_files(spark, files[:2], read, folder)
    before = {r.dataset: r.n_rows for r in sketches.growing_summary(sketches.read_sketches(spark, folder)).collect()}
    assert before["all"] == sum(r[0] in ("f0", "f1") for r in rows)
    assert [f[-2:] for f in sketches.add_files(spark, files, read, folder)] == ["f2", "f3"]
    assert sketches.add_files(spark, files, read, folder) == []
    assert read_paths == [["f0", "f1"], ["f2", "f3"]]

    table = sketches.read_sketches(spark, folder)
    exact = {r.dataset: r for r in profile.corpus_summary(read(files)).collect()}
    got = {r.dataset: r for r in sketches.growing_summary(table).collect()}
    assert got.keys() == exact.keys() == {"all", "one", "two"}
    for name, r in got.items():
        assert (r.n_rows, r.mean_length, r.mean_score) == pytest.approx((exact[name].n_rows, exact[name].mean_length, exact[name].mean_score))
        assert r.unique_words == pytest.approx(exact[name].unique_words, rel=0.02)
        assert r.unique_chars == pytest.approx(exact[name].unique_chars, rel=0.02)
    for r in sketches.growing_quantiles(table, (0.0, 0.1, 0.5, 0.99, 1.0)).collect():
        scores = [x[3] for x in rows if x[3] is not None and r.dataset in ("all", x[4])]
        assert r.n_scores == len(scores) and r.low <= r.value <= r.high
        below, upto = np.mean(np.array(scores) < r.value), np.mean(np.array(scores) <= r.value)
        assert below - r.rank_error - 1 / len(scores) <= r.prob <= upto + r.rank_error + 1 / len(scores)
    plan = sketches.sketch_files(read(files), "file")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_sketches_of_rows_without_scores_or_text(spark):
    from textscore.operators import sketches

    df = spark.createDataFrame([("f", 1, None, None, "a"), ("f", 2, "x", None, "a")], "file string, id int, text string, score double, cat string")
    table = sketches.sketch_files(Corpus(df, "id", "text", "score", "cat"), "file")
    r = {r.dataset: r for r in sketches.growing_summary(table).collect()}["a"]
    assert (r.n_rows, r.unique_words, r.unique_chars, r.mean_length, r.mean_score) == (2, 1, 1, 0.5, None)
    assert sketches.growing_quantiles(table, (0.5,)).collect() == []
