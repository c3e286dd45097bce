import numpy as np
import pyarrow as pa

from textscore.operators import explain, matrix
from textscore.plans.scoring import mean_pool_network


def test_a_batch_of_lists_is_taken_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(matrix, "VALUES_AT_ONCE", 4)
    lists = pa.array([[9], [1, 2, 3], None, [], [4], [5] * 6, [7]], pa.list_(pa.int32())).slice(1)
    seen = []

    def make(part, more):
        seen.append((len(part), len(part.flatten()), len(more)))
        return pa.array([sum(x or []) for x in part.to_pylist()], pa.int64())

    assert matrix.by_parts(make, lists, pa.array(range(6))).to_pylist() == [6, 0, 0, 4, 30, 7]
    assert seen == [(4, 4, 4), (1, 6, 1), (1, 1, 1)]
    assert matrix.by_parts(make, lists.slice(0, 0), pa.array([], pa.int64())).to_pylist() == []
    scores = pa.array([[3.0, 1.0, 2.0], [], [1.0] * 5, None], pa.list_(pa.float64()))
    whole = explain.shade_lists(scores, 256)
    assert matrix.by_parts(lambda part: explain.shade_lists(part, 256), scores).to_pylist() == whole.to_pylist()


def test_nodes_of_a_path_are_found_once_and_batches_stay_small(monkeypatch):
    groups = explain.padded_groups(np.full(40, 500), 64)
    assert max(len(g) for g in groups) * 500 * 64 <= 100_000 and sum(map(len, groups)) == 40
    found = []
    monkeypatch.setattr(np.polynomial.legendre, "leggauss", lambda n, f=np.polynomial.legendre.leggauss: found.append(n) or f(n))
    w, b = np.random.default_rng(0).normal(size=(3, 4)), np.zeros(3)
    net = mean_pool_network(w, b)
    mask = np.array([[True, True, False], [True, True, True]])
    x = np.where(mask[:, :, None], np.random.default_rng(1).normal(size=(2, 3, 4)), 0)
    for m in (mask, mask[1:]):
        part = x[-len(m):]
        for _ in range(2):
            scores, target, z, z0 = explain.path_scores(net, part, m, None, 37)
            gain = z[np.arange(len(m)), target] - z0[np.arange(len(m)), target]
            np.testing.assert_allclose((scores * m).sum(1) * 4, gain, atol=1e-9)
    assert found == [37]
