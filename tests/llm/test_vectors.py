import numpy as np
import pytest

from textscore.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node string, size string"


def cloud(seed: int = 3, n: int = 240) -> list[tuple]:
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, 16))
    near = base[rng.integers(0, len(base), n - len(base))] + rng.normal(size=(n - len(base), 16)) * rng.choice([0, .02, .1, .25], (n - len(base), 1))
    both = np.concatenate((base, near)).astype(np.float32)
    return [(i * 3, v.tolist(), int(rng.integers(0, 3)), "x", "x") for i, v in enumerate(both)]


def odd() -> list[tuple]:
    one = [1.0] + [0.0] * 15
    return [(9001, None, 1, "x", "x"), (9002, [0.0] * 16, 1, "x", "x"), (9003, [float("nan")] + one[1:], 1, "x", "x"), (9004, [float("inf")] + one[1:], 1, "x", "x"),
            (9005, [None] + one[1:], 1, "x", "x"), (9006, one, None, "x", "x"), (9007, [], 1, "x", "x"), (9008, one, 77, "x", "x"), (9009, one, 77, "x", "x"),
            (9010, [2.0] + [0.0] * 15, 77, "x", "x"), (9011, [1.0, 0.0], 77, "x", "x"), (None, one, 77, "x", "x"), (9012, [1e-30] * 16, 77, "x", "x"), (9013, [3e-30] * 16, 77, "x", "x")]


def brute_force(rows: list[tuple]) -> dict:
    good = {}
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[i] = (label, np.array(v, np.float32).astype(float))
    links = {i: set() for i, *_ in rows if i is not None}
    for i, (a, u) in good.items():
        for j, (b, w) in good.items():
            if i != j and a == b and len(u) == len(w) and u @ w / (np.linalg.norm(u) * np.linalg.norm(w)) >= 0.93:
                links[i].add(j)
    root = {i: i for i in links}
    changed = True
    while changed:
        changed = False
        for i, js in links.items():
            low = min([root[i], *(root[j] for j in js)])
            changed, root[i] = changed or low != root[i], low
    return {i: (len(links[i]), root[i], root[i] == i) for i in links}


@pytest.mark.parametrize("chunk", [2048, 16])
def test_rows_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(vectors, "CHUNK_ROWS", chunk)
    rows = cloud() + odd()
    got = vectors.embedding_near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["vec_id"]: tuple(r)[1:] for r in got if r["vec_id"] is not None} == brute_force(rows)
    assert [tuple(r) for r in got if r["vec_id"] is None] == [(None, 0, None, False)]


def test_copies_and_repeated_rows_are_counted_once_each(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(5, one, 1, "x", "x")] * 2 + [(i, one, 1, "x", "x") for i in range(6, 40)]
    got = {tuple(r) for r in vectors.embedding_near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(5, 35, 5, True)} | {(i, 35, 5, False) for i in range(6, 40)}
    assert vectors.embedding_near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 33)) * rng.uniform(0.01, 10, (200, 33))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    codes, scale, left = vectors.quantised(unit)
    for threshold in (0.0, 0.3, 0.6):
        a, b = vectors.doubtful(codes, scale, left, slice(0, 200), slice(0, 200), threshold)
        assert set(zip(*np.nonzero(unit @ unit.T >= threshold))) <= set(zip(a, b))
