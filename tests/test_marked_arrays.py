"""Marks made for whole batches are those made token by token."""

import random

import numpy as np
import pyarrow as pa

from textscore.operators import explain


def _cases():
    rnd = random.Random(2)
    for i in range(60):
        text = "".join(rnd.choices('ab é€😀<>&"\n ', k=rnd.randint(0, 14)))
        cuts = sorted(rnd.sample(range(len(text) + 1), 2 * rnd.randint(0, (len(text) + 1) // 2)))
        spans = list(zip(cuts[::2], cuts[1::2]))
        colors = [rnd.choice(["#ffffff", "#16ce10"]) for _ in spans]
        if i % 7 == 3 and spans:
            colors[0] = None
        if i % 7 == 5 and spans:
            spans, colors = [*spans, spans[-1]], [*colors, "#000000"]  # two tokens of one character
        yield (None, [], []) if i % 11 == 10 else (text, spans, colors)


def test_marks_of_a_batch_are_those_of_each_token(spark, monkeypatch):
    cases = list(_cases())
    rows = [(i, t, [{"start": a, "end": b} for a, b in s], c) for i, (t, s, c) in enumerate(cases)]
    kind = "id int, text string, offsets array<struct<start:int,end:int>>, colors array<string>"
    df = spark.createDataFrame(rows, kind).coalesce(1)
    got = {r.id: r.html for r in explain.highlight_lists(df, "text").collect()}
    assert got == {i: "" if t is None else explain.marked_text(t, None, [a for a, _ in s], [b for _, b in s], c)
                   for i, (t, s, c) in enumerate(cases)}


def test_no_python_step_per_token(monkeypatch):
    text, tokens = pa.array(["ab é cd", "x<y"]).slice(0, 2), (np.array([0, 3, 5, 0]), np.array([2, 4, 7, 1]))
    monkeypatch.setattr(explain, "marked_text", None)
    mark = lambda word, color: f'{explain.MARK_OPEN}{color}">{word}{explain.MARK_CLOSE}'
    got = explain.marked_texts(text, *tokens, pa.array(["#1", "#2", "#1", "#3"]), np.array([3, 1])).to_pylist()
    assert got == [f"{mark('ab', '#1')} {mark('é', '#2')} {mark('cd', '#1')}", f"{mark('x', '#3')}&lt;y"]
