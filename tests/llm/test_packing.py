import zlib

import numpy as np
import public_tokenizers as public
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textscore.llm import packing

PATH = public.path("byte_bpe_50k.json")


def encoder():
    coder = Tokenizer.from_file(PATH)
    coder.encode_special_tokens = True
    return lambda text: np.array([*coder.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check(rows: list, expected: dict[int, np.ndarray]) -> list[int]:
    by_doc: dict = {}
    by_sequence: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == expected.keys()
    for doc, pieces in by_doc.items():
        ids, at = expected[doc], 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at:at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    lengths = []
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and {p["tier"] for p in pieces} == {at if at & (at - 1) == 0 else 2048}
        lengths.append(at)
    return lengths


def test_plain_rows(plain):
    encode = encoder()
    lengths = check(packing.pack_documents(plain, PATH, public.PATTERN).collect(), {r["doc_id"]: encode(r["text"]) for r in plain.collect()})
    padded = sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths)
    assert padded <= 0.02 * sum(lengths)


def test_added_tokens_are_read_as_the_library_does_by_default(plain, spark):
    library = Tokenizer.from_file(PATH)
    coder = packing.Encoder(packing.read_byte_bpe(PATH), public.PATTERN, packing.read_added_tokens(PATH))
    texts = ["a<|endoftext|>b", "<|endoftext|>", "a <|endoftext|><|endoftext|> b\n\n<|endoftext|>\n c", "<|endoftext|", "x  <|endoftext|>  y", ""]
    for text in texts:
        assert coder.ids(text) == library.encode(text, add_special_tokens=False).ids
    assert coder.ids("a<|endoftext|>b") == [64, 50256, 65]
    expected = {r["doc_id"]: np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4") for r in plain.collect()}
    check(packing.pack_documents(plain, PATH, public.PATTERN, added=True).collect(), expected)


def test_repeated_rows_null_ids_and_no_rows(messy, nothing, monkeypatch):
    monkeypatch.setattr(packing, "DOCS_IN_SHARD", 7)
    encode = encoder()
    rows = packing.pack_documents(messy, PATH, public.PATTERN).collect()
    assert sum(r["length"] for r in rows) == sum(len(encode(r["text"])) for r in messy.collect())
    assert {r["length"] for r in rows if r["doc_id"] == 3} == {1} and any(r["doc_id"] is None for r in rows)
    assert packing.pack_documents(nothing, PATH, public.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=60))
def test_pack_keeps_every_token_and_pads_little(lengths):
    rests = [packing.Piece(i, 0, n, 0) for i, n in enumerate(lengths)]
    atoms = [[0] * n.bit_count() for n in lengths]
    sequences = packing.pack(rests, atoms, 64, 3)
    held = sorted((p.doc, p.start + k) for s in sequences for p in s for k in range(p.length))
    assert held == [(i, k) for i, n in enumerate(lengths) for k in range(n)]
    for s in sequences:
        n = sum(p.length for p in s)
        assert n <= 64 and (n & (n - 1) == 0 or 64 - n <= 3)


def test_steps_are_balanced():
    lengths = [2048] * 100 + [1024] * 17 + [3, 8]
    steps = packing.balanced_steps(lengths, 2048)
    sums = np.bincount(steps, lengths)
    assert sums.max() - sums.min() <= 2048


def test_long_runs_of_blanks_equal_the_library(spark):
    library = Tokenizer.from_file(PATH)
    texts = {2**53 + 1: "a" + " " * 1_200_000 + "b", 2**53 + 3: " " * 10 + "x", 5: "\n" * 300_000 + " y"}
    rows = [(i, t) for i, t in texts.items()] + [(None, "no name")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH, public.PATTERN, added=True).collect()
    expected = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in rows}
    check(got, expected)
    assert {type(r["doc_id"]) for r in got} == {int, type(None)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80), st.integers(1, 4))
def test_tiers_hold_every_piece_once_and_fit(lengths, tiers):
    rests = [packing.Piece(i, 0, n, 0) for i, n in enumerate(lengths)]
    done, long = packing.pack_tiers(rests, 64, tiers)
    assert sorted(p.doc for s in done + long for p in s) == list(range(len(lengths)))
    assert all(packing.total(s).bit_count() == 1 and packing.total(s) <= 64 for s in done) and all(packing.total(s) <= 64 for s in long)
    for a, b in zip(long, long[1:]):
        assert packing.total(a) + packing.total(b) > 32


def test_short_tiers_fill_the_gaps_of_long_ones():
    pieces = [packing.Piece(i, 0, n, 0) for i, n in enumerate([50, 10, 4, 30, 2, 16, 7])]
    done, long = packing.pack_tiers(pieces, 64, 3)
    assert sorted(sorted(p.length for p in s) for s in done) == [[2, 30], [4, 10, 50], [16]] and [[p.length for p in s] for s in long] == [[7]]
