"""License scan: exact phrases, and short notices within a few edits found from exact seeds."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textscore.llm.common import slices, whole_text

CHARS_PER_EDIT = 12

# Phrases of the base labels, and openings of public notices, in lower-case words.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("epl", "made available under the terms of the eclipse public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc", "licensed under a creative commons attribution"),
    ("proprietary", "all rights reserved"),
)

#: ASCII bytes to themselves in lower case where they are letters or digits, to a blank elsewhere; other bytes stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


@dataclass(frozen=True)
class Hit:
    """A notice found: its label, first and last word, and edits."""

    label: str
    first_word: int
    last_word: int
    edits: int
    length: int


def word_end(joined: str, at: int) -> int:
    """The first word end from a place on."""
    end = joined.find(" ", at)
    return len(joined) if end < 0 else end


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def meets(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of the spans, which are in order and apart, overlaps."""
    k = bisect_left(spans, (end,))
    return k > 0 and spans[k - 1][1] > start


class Notices:
    """Notices with their seeds in one automaton and a bounded-error pattern each.

    With k edits one of k + 1 parts of a notice stands unchanged, so its seeds meet every place within k edits.
    """

    def __init__(self, notices: tuple[tuple[str, str], ...] = NOTICES) -> None:
        self.notices = notices
        self.edits, self.patterns = [], []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text) in enumerate(notices):
            k = max(1, len(text) // CHARS_PER_EDIT)
            cuts = [len(text) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(text[a:b], []).append((i, a))
            self.edits.append(k)
            pattern = rf"(?<![^ ])(?:{regex.escape(text, literal_spaces=True)}){{e<={k}}}(?![^ ])"
            self.patterns.append((regex.compile(pattern), regex.compile("(?b)" + pattern)))
        self.seeds = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()

    def places(self, i: int, joined: str, low: int, high: int) -> Iterator[tuple[int, int, int, int]]:
        """Edits, start, end and ``i`` of every place of notice ``i`` between two word limits.

        The first match is refined near itself only, as the best of the whole part may stand far behind worse places.
        """
        anywhere, best = self.patterns[i]
        size, k = len(self.notices[i][1]), self.edits[i]
        while first := anywhere.search(joined, low, high):
            m, begin = first, first.start()
            while True:
                reach = min(high, word_end(joined, m.end() + size + k + 1))
                better = best.search(joined, begin, reach)
                while better and better.start() >= m.end():  # a place of its own, which has its turn later
                    better = best.search(joined, begin, better.start())
                if not better or sum(better.fuzzy_counts) >= sum(m.fuzzy_counts):
                    break
                m = better
            if m.start() - begin >= size - k:
                yield from self.places(i, joined, begin, m.start())
            yield sum(m.fuzzy_counts), m.start(), m.end(), i
            low = max(m.end(), low + 1)

    def find(self, joined: str) -> list[Hit]:
        """Hits in words joined by single blanks; where hits overlap, those with the fewest edits, once for a label."""
        windows: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.seeds.iter(joined):
            start = end + 1 - size
            for i, offset in places:
                k = self.edits[i]
                windows.setdefault(i, []).append((start - offset - k - 1, start - offset + len(self.notices[i][1]) + k + 1))
        found: list[tuple[int, int, int, int]] = []
        for i, spans in windows.items():
            for low, high in joined_spans(spans):
                found += self.places(i, joined, max(0, low), word_end(joined, high))
        if not found:
            return []
        blanks = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4") == 32)
        hits: list[Hit] = []
        better: list[tuple[int, int]] = []  # taken with fewer edits, apart from each other
        own: dict[str, list[tuple[int, int]]] = {}  # taken by label, apart from each other and in order
        for edits, group in groupby(sorted(found), key=lambda f: f[0]):
            for _, start, end, i in group:
                label, text = self.notices[i]
                mine = own.setdefault(label, [])
                if meets(better, start, end) or meets(mine, start, end):
                    continue
                insort(mine, (start, end))
                first, last = np.searchsorted(blanks, (start, end)).tolist()
                hits.append(Hit(label, first, last, edits, len(text)))
            better = joined_spans([span for mine in own.values() for span in mine])
        return sorted(hits, key=lambda h: (h.first_word, h.label))


def phrase_places(joined: bytes, phrases: dict[str, str]) -> list[tuple[int, str]]:
    """Word position and label of every place of a phrase in words joined by single blanks."""
    padded, places = b" " + joined + b" ", []
    for phrase, label in phrases.items():
        sought = b" " + phrase.encode() + b" "
        at, before, words = padded.find(sought), 0, 0
        while at >= 0:
            words += padded.count(b" ", before, at)
            before = at
            places.append((words, label))
            at = padded.find(sought, at + 1)
    return sorted(places)


RESULT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "spans array<struct<label:string,first_word:long,last_word:long,edits:int>>")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 phrases: dict[str, str] = PHRASES, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """License labels of every row: exact phrases, and notices within one edit per ``CHARS_PER_EDIT`` characters.

    Returns ``id_col``, ``n_words``, ``n_base``, ``first_word``, ``last_word`` (starts of phrases, null without one), ``base_labels``,
    ``labels`` (distinct, sorted, comma-joined; empty without one), ``score`` (1 for a phrase, else the share of a notice
    that is unchanged, 0 without one) and ``spans`` of the notices by words. A null text counts as empty: no
    words, no labels. One pass over whole texts without a shuffle. Repeated rows are scanned alike; other columns are
    left out. No rows give no rows.
    """
    def scan(text: str, known: Notices) -> dict:
        words = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
        joined = b" ".join(words)
        base = phrase_places(joined, phrases)
        hits = known.find(joined.decode("utf-8", "surrogatepass"))
        base_labels = sorted({label for _, label in base})
        return {
            "n_words": len(words), "n_base": len(base), "first_word": base[0][0] if base else None,
            "last_word": base[-1][0] if base else None, "base_labels": ",".join(base_labels),
            "labels": ",".join(sorted({*base_labels, *(h.label for h in hits)})),
            "score": 1.0 if base else max((1 - h.edits / h.length for h in hits), default=0.0),
            "spans": [{"label": h.label, "first_word": h.first_word, "last_word": h.last_word, "edits": h.edits} for h in hits],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Notices(notices)
        kind = pa.schema([
            ("id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
            ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
            ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())])))])
        for batch in slices(batches):
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            yield pa.RecordBatch.from_pylist([{"id": i, **scan(t, known)} for i, t in zip(ids, texts)], schema=kind)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, f"id long, {RESULT}").withColumnRenamed("id", id_col)
