import numpy as np
import pytest
import xxhash

from textscore.llm import components as parts
from textscore.llm import simhash


def fingerprint(text: str) -> int:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = lower.encode().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes) > 0)


def pieces(nodes, links) -> dict:
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_messy_rows_equal_brute_force(messy):
    rows = [(r["doc_id"], fingerprint(r["text"])) for r in messy.collect()]
    known = [(i, f) for i, f in rows if i is not None]
    links = [(a, b) for a, f in known for b, g in known if a < b and (f ^ g).bit_count() <= 4]
    root = pieces([i for i, _ in known], links)
    of = {f: root[i] for i, f in known}
    got = simhash.simhash_near_dedup(messy)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((i, f"{f:016x}", of.get(f))) for i, f in rows)


@pytest.mark.parametrize("radius", [1, 3, 4, 7])
def test_bit_sliced_pairs_equal_all_pairs(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 2 ** 63, 300, dtype=np.uint64)
    near = fps[rng.integers(0, 300, 400)]
    for _ in range(radius):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64))
    fps = np.unique(np.concatenate((fps, near)))
    got = {(int(i), int(j)) for a, b in simhash.near_pairs(fps, radius) for i, j in zip(a, b)}
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= radius
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(near)) if i < j} and got


def test_every_mask_plan_meets_every_pair():
    rng = np.random.default_rng(1)
    for count in (10, 10 ** 6, 10 ** 9, 10 ** 12):
        masks = simhash.plan_masks(count, 4)
        for _ in range(300):
            flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(flips & m == 0 for m in masks)


def test_hot_buckets_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 8)
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 2 ** 14, 400, dtype=np.int64))  # all alike in the upper bits
    rows = [(int(f), i) for i, f in enumerate(fps)]
    nodes = spark.createDataFrame(rows, "fp long, node long")
    found = {r["node"]: r["component"] for r in parts.components(simhash.links_of(nodes, 2)).collect()}
    near = [(a, b) for a, f in enumerate(fps) for b, g in enumerate(fps) if a < b and int(f ^ g).bit_count() <= 2]
    root = pieces(range(len(fps)), near)
    assert {n: found.get(n, n) for n in root} == root


def test_components_of_a_path_a_star_and_loops(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1040)] + [(5000, 5000), (7, 3), (7, 3)]
    frame = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = {r["node"]: r["component"] for r in parts.components(frame).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 1000 for i in range(1001, 1040)}}


def test_one_of_each_keeps_columns_and_first_ids(messy, nothing):
    kept = simhash.one_of_each(messy)
    assert kept.columns == messy.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 53 not in ids and 63 not in ids and ids.count(43) == messy.where("doc_id = 43").count() == 3  # 43 has the text of 53 too
    assert simhash.simhash_near_dedup(nothing).count() == 0 and simhash.one_of_each(nothing).count() == 0
