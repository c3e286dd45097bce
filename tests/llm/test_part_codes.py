import hashlib

import numpy as np
import pytest

from test_vectors import SCHEMA, cloud, odd
from textscore.llm import part_codes


def whole_rows(rows, parts):
    out = []
    for i, v, label, *_ in rows:
        if v and len(v) % parts == 0 and all(x is not None and np.isfinite(x) for x in v):
            out.append((i, label, [int(np.floor(4096 * float(np.float32(x)))) for x in v]))
    first = min((r for r in out if r[0] is not None), key=lambda r: (r[0], r[2]), default=None)
    return [r for r in out if first and len(r[2]) == len(first[2])]


def nearest(point, book):
    return min((sum((a - b) ** 2 for a, b in zip(point, entry)), e) for e, entry in enumerate(book))


def brute_force(rows, parts=8, entries=16, rounds=6):
    whole = whole_rows(rows, parts)
    d = len(whole[0][2]) // parts
    cut = [(i, label, [v[p * d:(p + 1) * d] for p in range(parts)]) for i, label, v in whole]
    seeds = {}
    for i, _, v in sorted((r for r in cut if r[0] is not None), key=lambda r: (r[0], r[2])):
        seeds.setdefault(i, v)
    books = [[seeds[i][p] for i in sorted(seeds)[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            of = [(nearest(v[p], books[p])[1], v[p]) for _, _, v in cut]
            for e in range(len(books[p])):
                mine = [x for k, x in of if k == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    out, totals = [], {}
    for i, label, v in cut:
        near = [nearest(v[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in near), sum(a for a, _ in near), label))
        totals[label] = totals.get(label, 0) + out[-1][2]
    return sorted(((i, code, error, totals[label], digest) for i, code, error, label in out), key=repr)


def test_rows_equal_brute_force(spark):
    rows = cloud() + odd() + cloud()[:7] + [(3, cloud()[9][1], None, "x", "x"), (3, cloud()[8][1], 2, "x", "x"), (9100, [0.5] * 24, 1, "x", "x")]
    got = part_codes.part_codes(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_force(rows)


def test_few_rows_and_none(spark):
    rows = [(5, [0.25] * 8, 1, "x", "x"), (7, [-0.25] * 8, None, "x", "x"), (7, [-0.25] * 8, None, "x", "x")]
    got = part_codes.part_codes(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_force(rows)
    for none in ([], [(1, None, 1, "x", "x"), (None, [0.5] * 8, 1, "x", "x"), (3, [], 1, "x", "x")]):
        empty = part_codes.part_codes(spark.createDataFrame(none, SCHEMA))
        assert empty.count() == 0 and empty.columns == got.columns


def test_distances_that_do_not_fit_fail(spark):
    with pytest.raises(Exception, match="would not be exact"):
        part_codes.part_codes(spark.createDataFrame([(1, [1e30] * 8, 1, "x", "x")], SCHEMA)).count()


@pytest.mark.parametrize("entries, dims, spread", [(16, 8, 900), (16, 8, 3), (1, 4, 50), (70, 3, 20), (130, 2, 4)])
def test_masks_find_the_nearest_entry(entries, dims, spread):
    rng = np.random.default_rng(entries)
    book = rng.integers(-spread, spread + 1, (entries, dims))
    points = np.concatenate((rng.integers(-3 * spread, 3 * spread, (400, dims)), book, book + 1, np.full((2, dims), 100_000)))
    masks = part_codes.EntryMasks(book)
    away = np.square(points[:, None, :] - book[None]).sum(2)
    code, error = masks.nearest(points)
    assert (error == away.min(1)).all() and (code == away.argmin(1)).all()
    radius = rng.integers(0, 2 * spread, len(points))
    boxes = masks.in_box(points, radius)
    inside = (np.abs(points[:, None, :] - book[None]) <= radius[:, None, None]).all(2)
    assert all(((boxes[:, e // 64] >> np.uint64(e % 64) & np.uint64(1)) == inside[:, e]).all() for e in range(entries))
