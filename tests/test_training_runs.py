"""Merges inside runs of symbols, held as arrays."""

import random
from collections import Counter

import pyarrow as pa

from textscore.operators import pair_index
from textscore.operators.pair_index import EDGE, PairTotals, Runs, Symbols, merge_runs


def _counted(texts, times):
    totals = Counter()
    for text, n in zip(texts, times):
        for a, b in zip(text, text[1:]):
            totals[a + b] += n
    return totals


def test_a_merge_changes_totals_by_the_exact_differences():
    rnd = random.Random(4)
    texts = [EDGE + "".join(rnd.choices("aab", k=rnd.randint(2, 9))) + rnd.choice(["c", EDGE]) for _ in range(60)]
    times = [rnd.randint(1, 9) for _ in texts]
    held, totals = Runs(texts, times), _counted(texts, times)
    for pair, symbol in (("aa", "A"), ("ab", "B"), ("AA", "C"), ("AB", "B"), ("Bb", "D")):  # the fourth makes a symbol there is
        if held.outside[pair]:
            continue
        texts = [t[0] + t[1:-1].replace(pair, symbol) + t[-1] for t in texts]
        totals.update(held.merge(pair, symbol))
        want = _counted(texts, times)
        assert {p: n for p, n in totals.items() if n and EDGE not in p} == {p: n for p, n in want.items() if n and EDGE not in p}
        sides = _counted([t[:2] for t in texts], times) + _counted([t[-2:] for t in texts], times)
        assert {p: n for p, n in held.outside.items() if n} == dict(sides)


def test_few_rounds_decide_many_merges(spark, monkeypatch):
    """A round fetches its runs as columns, so that several times as many fit the driver and rounds are few."""
    rounds, runs = [], pair_index.runs

    def seen(words, pairs):
        rounds.append(found := runs(words, pairs))
        return found

    monkeypatch.setattr(pair_index, "runs", seen)
    rnd = random.Random(6)
    words = {"".join(rnd.choices("abcdefghijklmnop", [30 - i for i in range(16)], k=rnd.randint(1, 9))): 1 + i % 9 for i in range(4000)}
    symbols = Symbols(sorted(set("".join(words))), sorted(set("".join(words))))
    pair_index.train(spark.createDataFrame(list(words.items()), "s string, n bigint").coalesce(2), symbols, 300)
    assert len(symbols.merges) == 284 and len(rounds) <= 6 and all(isinstance(r, pa.Table) for r in rounds)


def test_the_best_pair_beside_a_run_ends_the_round():
    texts, times = [EDGE + "ab" + "c", "c" + "ab" + EDGE], [3, 2]
    symbols = Symbols(list("abc"), list("abc"))
    totals = PairTotals({"ab": 5, "bc": 9, "ca": 2}, 0)
    done, stale = merge_runs(pa.table({"run": texts, "n": times}), ["ab", "bc"], totals, symbols, 10)
    assert (done, stale) == ([], False)
