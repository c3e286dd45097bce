import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textscore.corpus import Corpus
from textscore.operators import sampling
from textscore.operators.selection import (
    column_order, hash_order, keep_first, positions, positions_after, range_bucket, split_at,
)


def key(i, seed):
    return hashlib.md5(f"{i}-{seed}".encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    """2,000 rows; one group holds two thirds of them."""
    g = F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7))
    return spark.range(2000, numPartitions=6).withColumn("g", g).cache()


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.g, []).append(r.id)
    return out


def test_keep_first_by_hash_equals_brute_force(spark, skewed):
    got = groups(keep_first(skewed, ["g"], hash_order(skewed, "id", 5), 40))
    for g, ids in groups(skewed).items():
        assert sorted(got[g]) == sorted(sorted(ids, key=lambda i: (key(i, 5), i))[:40])


def test_keep_first_by_column(spark, skewed):
    got = groups(sampling.reduce_per_category(skewed, 25, "g", "id"))
    for g, ids in groups(skewed).items():
        assert sorted(got[g]) == sorted(ids)[:25]


@pytest.mark.parametrize("n,left", [(0, 0), (-3, 0), (1, 1), (10_000, 2000)])
def test_keep_first_limits(spark, skewed, n, left):
    assert keep_first(skewed, [], hash_order(skewed, "id", 1), n).count() == left


def test_split_at_several_cuts(spark, skewed):
    parts = split_at(skewed, ["g"], hash_order(skewed, "id", 2), [0, 5, F.col("_total") - 1, F.col("_total")])
    got = {}
    for r in parts.collect():
        got.setdefault(r.g, []).append((r.part, key(r.id, 2)))
    for rows in got.values():
        n, rows = len(rows), sorted(rows, key=lambda r: r[1])
        assert [p for p, _ in rows] == [1] * 5 + [2] * (n - 6) + [3]


def test_positions_by_group(spark, skewed):
    got = {}
    for r in positions(skewed, hash_order(skewed, "id", 9), ["g"]).collect():
        got.setdefault(r.g, {})[r.id] = r.pos
    for g, ids in groups(skewed).items():
        assert got[g] == {i: p for p, i in enumerate(sorted(ids, key=lambda i: (key(i, 9), i)))}


def test_positions_after_value(spark, skewed):
    df = skewed.withColumn("n", F.col("id") % 4)
    got = {r.id: r.pos for r in positions_after(df, "n", column_order(df, "id")).collect()}
    assert got == {i: p for p, i in enumerate(sorted(range(2000), key=lambda i: (i % 4, i)))}


def test_results_do_not_depend_on_bucket_limits(spark, skewed):
    order = column_order(skewed, "id")
    odd = type(order)(order.key, range_bucket(F.col("id"), [3, 4, 1999]))
    assert positions(skewed, odd).collect() and sorted(r.pos for r in positions(skewed, odd).collect()) == list(range(2000))
    assert {r.id for r in keep_first(skewed, [], odd, 77).collect()} == set(range(77))


@pytest.mark.parametrize("limits", [[], [5], [1, 2, 3], list(range(0, 100, 3))])
def test_range_bucket(spark, limits):
    got = [r[0] for r in spark.range(-2, 105).select(range_bucket(F.col("id"), limits)).collect()]
    assert got == [sum(v <= i for v in limits) for i in range(-2, 105)]


def test_sample_n(spark, skewed):
    got = {r.id for r in sampling.sample_n(skewed, 300, "id", 4).collect()}
    assert got == set(sorted(range(2000), key=lambda i: key(i, 4))[:300])


def test_sample_per_group_excludes(spark, skewed):
    got = groups(sampling.sample_per_group(skewed, "g", 3, "id", exclude=["hot"]))
    assert "hot" not in got and all(len(v) == 3 for v in got.values())


def test_undersample(spark, skewed):
    sizes = Counter(r.g for r in skewed.collect())
    rows = sampling.undersample(skewed, "g", "id", 3).collect()
    assert len({r.id for r in rows}) == len(rows)
    assert Counter(r.g for r in rows) == {g: min(sizes.values()) for g in sizes}


@pytest.mark.parametrize("per_copy", [1, 7, 1000])
def test_oversample(spark, skewed, monkeypatch, per_copy):
    monkeypatch.setattr(sampling, "DRAW_BLOCK", 100)
    monkeypatch.setattr(sampling, "DRAWS_PER_COPY", per_copy)
    sizes = Counter(r.g for r in skewed.collect())
    rows = sampling.oversample(skewed, "g", "id", 3).collect()
    assert Counter(r.g for r in rows) == {g: max(sizes.values()) for g in sizes}
    assert len({r.id for r in rows if r.g == "hot"}) < sizes["hot"]
    assert all(sorted(r.draw for r in rows if r.g == g) == list(range(max(sizes.values()))) for g in sizes)
    member = {i: g for g, ids in groups(skewed).items() for i in ids}
    assert all(member[r.id] == r.g for r in rows)


@pytest.mark.parametrize("n,fractions,want", [
    (10, [0.8, 0.2], [8, 2]), (11, [0.5, 0.5], [6, 5]), (101, [0.5, 0.3, 0.2], [51, 30, 20]), (3, [0.9, 0.1], [3, 0]),
])
def test_split_exact_sizes(spark, n, fractions, want):
    df = spark.range(n)
    got = Counter(r.part for r in sampling.split_exact(df, fractions, "id").collect())
    assert [got.get(i, 0) for i in range(len(want))] == want


def test_fractions_must_add_up(spark):
    with pytest.raises(ValueError):
        sampling.split_exact(spark.range(3), [0.5, 0.4], "id")


def test_split_hash_shares(spark):
    got = Counter(r.part for r in sampling.split_hash(spark.range(20000), [0.8, 0.2], "id", 1).collect())
    assert abs(got[1] / 20000 - 0.2) < 0.02


def test_balanced_train_input(spark, skewed):
    with pytest.raises(ValueError):
        sampling.balanced_train_input(skewed, "g", "id", under=True, over=True)
    train, valid = sampling.balanced_train_input(skewed, "g", "id", 0.2, 1, over=True)
    train_ids, valid_ids = {r.id for r in train.collect()}, {r.id for r in valid.collect()}
    assert not train_ids & valid_ids and len(valid_ids) == 400


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(1, "abc", 1, "a"), (2, "abcdef", 2, "a"), (3, "", 3, "b"), (4, "x" * 50, 5, "0")]
    return Corpus(spark.createDataFrame(rows, "id int, text string, score int, cat string"), "id", "text", "score", "cat")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_falsy_filters_filter_nothing(corpus):
    assert ids(sampling.filter_rows(corpus, category="", length=0)) == [1, 2, 3, 4]
    assert ids(sampling.filter_rows(corpus, score=0)) == []


def test_filters(corpus):
    assert ids(sampling.filter_rows(corpus, category="a")) == [1, 2]
    assert ids(sampling.filter_rows(corpus, length=3)) == [1, 3]
    assert ids(sampling.filter_rows(corpus, length=[3, 6])) == [1, 2]
    assert ids(sampling.filter_rows(corpus, score=[2, 3])) == [2, 3]
    assert ids(sampling.filter_rows(corpus, columns={"cat": ["a", "b"], "score": 3})) == [3]
    for bad in ({"length": "x"}, {"score": "x"}, {"score": 1, "standardized": True}):
        with pytest.raises(TypeError):
            sampling.filter_rows(corpus, **bad)
    with pytest.raises(ValueError):
        sampling.filter_length_range(corpus, 5, 1)


def test_filter_load(corpus):
    assert sampling.filter_load(corpus, n=2, fmt="index").columns == ["id"]
    assert sampling.filter_load(corpus, n=4).count() == 4
    with pytest.raises(ValueError, match="fewer"):
        sampling.filter_load(corpus, category="a", n=3)
    with pytest.raises(NotImplementedError):
        sampling.filter_load(corpus, fmt="other")
    coded = sampling.filter_load(corpus, n=1, score=5, fmt="train", encoder=lambda d: d.withColumn("ids", F.array(F.lit(1))))
    assert coded.first().y == 4
