import numpy as np
import pytest

from test_vectors import SCHEMA, cloud, odd
from textscore.llm import hard_negatives


def brute_force(rows, every, scale=256, most=5):
    whole = set()
    for i, v, label, *_ in rows:
        if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.add((i, label, tuple(int(np.floor(scale * float(np.float32(x)))) for x in v)))
    out = []
    for a in whole:
        if a[0] % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in whole if b != a and len(b[2]) == len(a[2]))
        for score, i, _ in [s for s in scored if s[2] == a[1]][:most]:
            fits = [s for s in scored if s[2] != a[1] and -80 * score <= -100 * s[0] <= -100 * score][:most]
            out += [(a[0], i, k + 1, s[1], -score, -s[0]) for k, s in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("block, anchors, depth", [(4096, 512, 32), (50, 7, 1)])
def test_rows_equal_brute_force(spark, monkeypatch, block, anchors, depth):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "ANCHORS_AT_ONCE", anchors)
    monkeypatch.setattr(hard_negatives, "FIRST_DEPTH", depth)
    rows = cloud() + odd() + cloud()[:9] + [(30, cloud()[50][1], 1, "x", "x"), (30, cloud()[50][1], 2, "x", "x"), (-60, cloud()[51][1], 0, "x", "x"),
                                            (9030, [], 1, "x", "x"), (9060, [], 1, "x", "x"), (9061, [], 2, "x", "x"), (9090, [0.0] * 16, 1, "x", "x")]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), every=30)
    want = brute_force(rows, 30)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50


def test_equal_scores_come_by_id(spark):
    one, half = [1.0] + [0.0] * 7, [0.9] + [0.0] * 7
    rows = [(0, one, 1, "x", "x")] + [(i, one, 1, "x", "x") for i in range(1, 9)] + [(i, half, 2, "x", "x") for i in range(50, 70)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect())) == brute_force(rows, 100)
    assert hard_negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([(1, one, 1, "x", "x")], SCHEMA)).count() == 0


def test_reading_stops_early_and_loses_nothing():
    rng = np.random.default_rng(1)
    rows = np.floor(rng.normal(size=(4000, 4)) * 256).astype(np.int64)
    lists = hard_negatives.SortedLists(rows)
    for anchor in (rows[0], rows[1], np.array([5, 0, 0, 0]), np.zeros(4, np.int64)):
        met, scores = lists.until(anchor, lambda met, scores, threshold: len(scores) >= 5 and threshold < np.partition(scores, -5)[-5])
        every = rows @ anchor
        assert (scores == every[met]).all() and len(set(met)) == len(met)
        assert sorted(scores)[-5:] == sorted(every)[-5:]
        assert len(met) < 2000 or not anchor.any()


def test_sums_beyond_doubles_are_exact():
    rows = np.array([[1 << 29, 3], [(1 << 29) + 1, -5], [7, 1 << 29]], np.int64)
    lists = hard_negatives.SortedLists(rows)
    assert not lists.exact and (lists.score(np.arange(3), rows[1]) == rows @ rows[1]).all()
