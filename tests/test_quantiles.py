import numpy as np
import pytest
from pyspark.sql import functions as F

from textscore.operators import quantiles, selection
from textscore.operators.quantiles import exact_quantiles

PROBS = [0, 0.1, 0.25, 0.5, 0.75, 0.99, 1]


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(2)
    rows = [("hot", float(v)) for v in rng.normal(size=3000)] + [("hot", 0.5)] * 2000
    rows += [("same", 4.0)] * 10 + [("one", 7.0), ("two", 1.0), ("two", 2.0), ("none", None), (None, 3.0)]
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(7).cache()


def test_quantiles_do_not_depend_on_size(values, monkeypatch):
    """The same bits whether summaries are pinned or not, and whatever the ranges are."""
    _, df = values
    small = {r.g: r.q for r in exact_quantiles(df, ["g"], "v", PROBS).collect()}
    monkeypatch.setattr(quantiles, "pin_small", lambda d: d)
    monkeypatch.setattr(selection, "MAX_RANGE_BUCKETS", 3)
    assert {r.g: r.q for r in exact_quantiles(df, ["g"], "v", PROBS).collect()} == small


def test_quantiles_equal_numpy(values):
    rows, df = values
    got = {r.g: r.q for r in exact_quantiles(df, ["g"], "v", PROBS).collect()}
    assert set(got) == {"hot", "same", "one", "two"}
    for g, q in got.items():
        np.testing.assert_allclose(q, np.quantile([v for k, v in rows if k == g], PROBS), atol=1e-12)


def test_hot_value_is_counted_before_the_shuffle(values, monkeypatch):
    monkeypatch.setattr(quantiles, "pin_small", lambda d: d)
    _, df = values
    written = []
    monkeypatch.setattr(quantiles, "via_table", lambda d, name: written.append(d) or d)
    exact_quantiles(df.select("g", F.round("v", 1).alias("v")), ["g"], "v", [0.5])
    assert "partial_count(1)" in written[0]._jdf.queryExecution().executedPlan().toString()
