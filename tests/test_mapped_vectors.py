"""Vectors that tasks map from a file, and results that leave a task part by part."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textscore.operators import explain, matrix, scoring
from textscore.plans.scoring import mean_pool_network

MANY, DIM = 262_144, 64


@pytest.fixture(scope="module")
def vecs(spark):
    numbers = F.transform(F.sequence(F.lit(1), F.lit(DIM)), lambda i: (F.pmod(F.col("id") * i, F.lit(7)) - 3).cast("float"))
    return spark.range(MANY).select(F.col("id").cast("int").alias("token_id"), numbers.alias("v"))


def vector(t):
    return np.array([t * i % 7 - 3 for i in range(1, DIM + 1)], float)


def test_vectors_of_any_number_reach_a_network_and_are_not_joined(spark, vecs):
    """Above 16 million numbers a network was refused, and scores came from a join of all distinct tokens."""
    rng = np.random.default_rng(0)
    w, b = rng.normal(size=(3, DIM)), rng.normal(size=3)
    docs = [(0, [1, 5, MANY - 1]), (1, []), (2, None), (3, [77_777] * 4)]
    df = spark.createDataFrame(docs, "doc int, ids array<int>")
    weights = spark.createDataFrame([(i, w[i].tolist(), float(b[i])) for i in range(3)], "class int, w array<double>, b double")
    by_network = {r.doc: r for r in explain.network_scores(df, "ids", vecs, mean_pool_network(w, b), DIM).collect()}
    scored = explain.token_scores(df, "doc", "ids", vecs, weights, DIM)
    assert "Join" not in scored._jdf.queryExecution().executedPlan().toString()
    closed = {r.doc: r for r in scored.collect()}
    for doc in (0, 3):
        m = np.mean([vector(t) for t in docs[doc][1]], axis=0)
        z = w @ np.tanh(m) + b
        factor = w[z.argmax()] * np.where(m == 0, 1, np.tanh(m) / np.where(m == 0, 1, m)) / len(docs[doc][1]) / DIM
        want = [vector(t) @ factor for t in docs[doc][1]]
        np.testing.assert_allclose(closed[doc].scores, want, atol=1e-12)
        np.testing.assert_allclose(by_network[doc].scores, want, atol=1e-9)
    assert closed[2].scores == [] and by_network[1].z is None


def test_the_rows_are_mapped(vecs):
    sent = scoring.mapped_matrix(vecs, DIM)
    found = sent.value
    assert isinstance(found.rows.base, np.memmap) and found.rows.dtype == np.float32 and found.rows.flags.aligned
    assert sent.value is found
    np.testing.assert_array_equal(found.take(found.places(np.array([MANY - 1, 3]))), [vector(MANY - 1), vector(3)])


def test_ids_with_gaps_repeats_and_in_no_order(spark):
    rows = [(9, [9.0]), (2, [2.0]), (5, [5.0]), (2, [0.0])]
    found = scoring.mapped_matrix(spark.createDataFrame(rows, "token_id int, v array<double>").coalesce(1), 1).value
    assert found.take(found.places(np.array([5, 2, 9, 2]))).ravel().tolist() == [5.0, 2.0, 9.0, 2.0]
    for wrong in (1, 3, 10):
        with pytest.raises(ValueError, match=f"no vector for token id {wrong}"):
            found.places(np.array([5, wrong]))
    for bad in ([(1, None)], [(1, [1.0, 2.0])], [(1, [None])], [(None, [1.0])]):
        with pytest.raises(Exception, match="token id is null, or a vector"):
            scoring.mapped_matrix(spark.createDataFrame(bad, "token_id int, v array<double>"), 1)


def test_marks_and_colours_leave_part_by_part(spark, monkeypatch):
    """All marks of a batch of texts were held at once, twice."""
    taken = []
    monkeypatch.setattr(explain.F, "arrow_udf", lambda kind: lambda f: taken.append(f) or (lambda *c: F.lit(None)))
    monkeypatch.setattr(matrix, "VALUES_AT_ONCE", 3)
    texts = ["ab cd", "", None, "x<y z", "q"]
    spans = [[(0, 2), (3, 5)], [], [], [(0, 1), (2, 3), (4, 5)], [(0, 1)]]
    offsets = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
    scores = pa.array([[float(i) for i, _ in enumerate(s)] for s in spans], pa.list_(pa.float64()))
    df = spark.createDataFrame([(1, "a", [1.0])], "id int, text string, scores array<double>").withColumn("offsets", F.lit(None))
    explain.color_lists(df)
    colors = list(taken.pop()(iter([scores])))
    assert len(colors) > 1
    colors = pa.concat_arrays(colors)
    explain.highlight_lists(df.withColumn("colors", F.lit(None)), "text")
    html = list(taken.pop()(iter([(pa.array(texts), offsets, colors)])))
    assert len(html) > 1 and max(map(len, html)) < 5
    want = ["" if t is None else explain.marked_text(t, None, [a for a, _ in s], [b for _, b in s], c)
            for t, s, c in zip(texts, spans, colors.to_pylist())]
    assert pa.concat_arrays(html).to_pylist() == want


def test_a_gradient_that_is_one_view_for_all_tokens_is_added_as_such():
    rng = np.random.default_rng(3)
    w, b = rng.normal(size=(3, 5)), rng.normal(size=3)
    plain = mean_pool_network(w, b)
    for lengths in ([4, 4], [4, 2], [1]):
        mask = np.arange(max(lengths)) < np.array(lengths)[:, None]
        x = np.where(mask[:, :, None], rng.normal(size=(*mask.shape, 5)), 0)
        whole = lambda *a: (plain(*a)[0], None if a[2] is None else np.array(plain(*a)[1]))
        got, want = (explain.path_scores(net, x, mask, None, 30) for net in (plain, whole))
        np.testing.assert_allclose(got[0] * mask, want[0] * mask, atol=1e-14)
        at = np.arange(len(mask))
        np.testing.assert_allclose((got[0] * mask).sum(1) * 5, (got[2] - got[3])[at, got[1]], atol=1e-9)


def test_sums_of_documents_without_tokens_are_kept_if_asked_for(spark):
    weights = spark.createDataFrame([(0, [1.0], 0.5)], "class int, w array<double>, b double")
    rows = [(1, [1.0, 2.0], 0, [3.5]), (2, [], 0, [0.5]), (3, None, 0, [0.5])]
    scored = spark.createDataFrame(rows, "doc int, scores array<double>, y_pred int, z array<double>")
    assert [tuple(r) for r in explain.ig_completeness(scored, "doc", weights, 1).collect()] == [(1, 3.0, 3.0)]
    kept = explain.ig_completeness(scored, "doc", weights, 1, "y_pred", empty=True).collect()
    assert sorted(map(tuple, kept)) == [(1, 0, 3.0, 3.0), (2, 0, None, None), (3, 0, None, None)]


def test_tokens_are_scored_once_for_both_sides_of_the_join(spark, sf, monkeypatch):
    from textscore.plans import scoring as plans

    monkeypatch.setattr(plans, "_network", lambda spark, d: plans.network.start("cross_entropy", plans.table_size(spark, d) + plans.K + 1, plans.K, 8))
    plan = plans.explain_network(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "ArrowEvalPython" not in plan
