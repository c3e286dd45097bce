import hashlib
import random
import re

import pytest

from conftest import prose
from textscore.llm import postings

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ITEM_SCHEMA = "item_id long, text string, row long, window string, term string, pos int"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def item_rows() -> list[tuple]:
    texts = [prose(2, 80), prose(7, 30), "one two", "Say|ENDOFTEXT", "ñandú 漢字", None, "", " ,.; ", "ab" * 200, "a a a a a a a a a a a a", prose(99, 40), prose(2, 80), "É"]
    return [(3 * i + 1, t, 1, "x", "x", 1) for i, t in enumerate(texts)] + [(4, prose(9, 15), 1, "x", "x", 1), (None, prose(11, 12), 1, "x", "x", 1)]


def windows_of(rows, size=10):
    found = set()
    for item, text, *_ in rows:
        w = words(text)
        n = min(size, len(w))
        found |= {(str(item) if item is not None else "", tuple(w[i:i + n])) for i in range(len(w) - n + 1 if n else 0)}
    return found


def brute_force(docs, items) -> list[tuple]:
    windows = windows_of(items)
    sizes = {len(w) for _, w in windows}
    by_words = {}
    for item, w in windows:
        by_words.setdefault(w, set()).add(item)
    out = []
    for i, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if tuple(w[at:at + n]) in by_words:
                    hit |= set(range(at, at + n))
                    found |= by_words[tuple(w[at:at + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_rows_equal_brute_force(spark, messy, monkeypatch, broadcast):
    monkeypatch.setattr(postings.at_most, "__defaults__", (broadcast,))
    docs = [tuple(r) for r in messy.collect()]
    got = postings.decontaminate(messy, spark.createDataFrame(item_rows(), ITEM_SCHEMA))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_force(docs, item_rows())


def test_hot_words_and_runs_of_one_word(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["a", "a", "a", "b", "c"]) for _ in range(rng.randrange(400)))) for i in range(60)] + [(99, "a " * 30_000)]
    items = [(1, "a " * 10), (2, "a b a a"), (3, "a"), (4, "b a"), (5, "a a a b a a c a a a a a"), (6, "never")]
    got = postings.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_force(docs, items)


def test_proximity_allows_the_slop_and_no_more(spark):
    docs = [(1, "k l quick brown fox"), (2, "quick very brown fox"), (3, "quick very very brown fox"), (4, "brown quick fox"), (5, "quick brown"), (6, "fox quick brown x x x fox")]
    frame, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("i", "quick brown fox")], "item_id string, text string")
    windows = postings.item_windows(items, "item_id", "text")
    index = postings.positional_index(frame, windows.terms, "doc_id", "text")
    totals = {r["term"]: r["total"] for r in index.frequency.collect()}
    slots = sorted((totals[r["term"]], r["offset"], r["term"]) for r in windows.slots.collect())
    lists = {}
    for r in index.postings.join(index.docs, "row").collect():
        lists.setdefault((r["id"], r["term"]), []).append(r["pos"])
    for slop in (0, 1, 2, 5):
        want = set()
        for i, _ in docs:
            for pos in lists.get((i, slots[0][2]), []):
                start = pos - slots[0][1]
                if all(any(abs(q - o - start) <= slop for q in lists.get((i, t), [])) for _, o, t in slots[1:]):
                    want.add((i, start))
        got = postings.phrase_places(index, windows.slots, slop).join(index.docs, "row")
        assert {(r["id"], r["start"]) for r in got.collect()} == want
        assert (1, 2) in want and ((2, 0) in want or (2, 1) in want) == (slop > 0)


def test_nothing_on_either_side(spark, nothing, messy):
    items = spark.createDataFrame(item_rows(), ITEM_SCHEMA)
    assert postings.decontaminate(nothing, items).count() == 0
    none = postings.decontaminate(messy, items.limit(0))
    assert none.where("contaminated").count() == 0 and none.count() == messy.count()


def test_no_python_and_no_pairing_in_the_plan(spark, messy):
    plan = postings.decontaminate(messy, spark.createDataFrame(item_rows(), ITEM_SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
