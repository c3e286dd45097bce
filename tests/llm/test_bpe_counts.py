import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from tokenizers import Tokenizer, models, normalizers

from textscore.llm import byte_bpe, token_counts

RANKS = public.path("byte_bpe_multi_50k.tiktoken")
PIECES = public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("block,buckets", [(16 << 20, 1024), (500, 1024), (500, 3)])
def test_messy_rows_equal_the_library(messy, library, monkeypatch, block, buckets):
    """Also with many small blocks, and with buckets whose words go to several tasks."""
    monkeypatch.setattr(byte_bpe, "BLOCK_BYTES", block)
    monkeypatch.setattr(byte_bpe, "MAX_BUCKETS", buckets)
    expected = []
    for r in messy.collect():
        text = r["text"] or ""
        ids = library.encode_ordinary(text)
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        expected.append((r["doc_id"], len(ids), sha, hashlib.sha256(text.encode()).hexdigest(), ids, text.encode()))
    got = byte_bpe.corpus_bpe(messy.repartition(3, "doc_id"), RANKS, public.PATTERN)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))


def test_blocks_number_words_by_bucket_and_count():
    block = byte_bpe.Block()
    texts = [["b", "a", "b", "c"], [], ["c", "b", "d"]]
    for i, words in enumerate(texts):
        block.add(i, "".join(words), words)
    cut, numbers = block.cut(2)
    assert block.lengths == [4, 0, 3] and block.ids == [0, 1, 2]
    assert [cut[n % 2][n // 2] for n in numbers.tolist()] == [w.encode() for words in texts for w in words]
    assert numbers[0] == zlib.crc32(b"b") % 2  # the commonest word comes first in its bucket
    assert byte_bpe.Block().cut(2)[1].tolist() == []


def test_texts_are_read_once(messy):
    plan = byte_bpe.corpus_bpe(messy, RANKS, public.PATTERN)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3 and "Union" not in plan


def test_words_of_any_length_equal_the_library(library):
    rng = random.Random(4)
    ranks = byte_bpe.read_ranks(RANKS)
    for n in [1, 2, 3, 7, 20, 47, 48, 49, 50, 90, 300, 1500]:
        for letters in ("ab", "etaoin shrdlu", "äöüß漢字", "0123456789"):
            word = "".join(rng.choice(letters) for _ in range(n)).encode()
            assert byte_bpe.encode_word(word, ranks) == library._encode_single_piece(word)


def test_numbers_and_decoding(nothing):
    numbers = np.array([0, 1, 255, 256, 70_000, 2 ** 32 - 1], "<u4")
    assert (byte_bpe.unpack_numbers(byte_bpe.pack_numbers(numbers)) == numbers).all()
    assert len(byte_bpe.unpack_numbers(byte_bpe.pack_numbers(numbers[:0]))) == 0
    table = byte_bpe.token_bytes({b"a": 0, b"bc": 1, b"d": 3})
    assert byte_bpe.decode_ids(np.array([1, 0, 3, 1]), table) == b"bcadbc"
    for unknown in (2, 4):
        with pytest.raises(ValueError):
            byte_bpe.decode_ids(np.array([unknown]), table)
    assert byte_bpe.corpus_bpe(nothing, RANKS, public.PATTERN).count() == 0


def unigram(pieces, **kind):
    coder = Tokenizer(models.Unigram(pieces, unk_id=0, **kind))
    coder.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return coder


def test_counts_equal_the_library(messy, nothing):
    coder = unigram(token_counts.read_pieces(PIECES), byte_fallback=True)
    got = token_counts.token_counts(messy, PIECES).collect()
    expected = [(r["doc_id"], len(coder.encode(r["text"] or "").ids)) for r in messy.collect()]
    assert sorted(map(str, [(r["doc_id"], r["n_tokens"]) for r in got])) == sorted(map(str, expected))
    assert token_counts.token_counts(nothing, PIECES).count() == 0


def test_literals_of_control_and_byte_pieces_are_text(spark):
    marks = token_counts.read_marks(PIECES)
    assert {"<unk>", "<s>", "</s>", "<0x00>", "<0xFF>"} <= marks and len(marks) == 259
    coder = unigram([(chr(0xF0000 + i) if p in marks else p, s) for i, (p, s) in enumerate(token_counts.read_pieces(PIECES))])
    texts = ["<s>", "a <s>old price</s> new", "<0x0A><0x41>", "<unk> x<unk>", "plain text"]
    rows = token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PIECES).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(coder.encode(t).ids) for i, t in enumerate(texts)}


@pytest.mark.parametrize("crossing", [False, True])
def test_ties_and_unknown_characters_equal_the_library(crossing):
    """Few scores make many ties; without byte pieces neighbouring unknown characters are one piece."""
    rng = random.Random(7 + crossing)
    names = {"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 4))) for _ in range(40)} | {"a", "▁"}
    names = sorted(n for n in names if crossing or "▁" not in n.lstrip("▁"))
    pieces = [("<unk>", 0.0), *((n, -float(rng.randint(1, 3))) for n in names)]
    coder, counts = unigram(pieces), token_counts.Counts(pieces)
    for _ in range(400):
        text = "".join(rng.choice("aabbcc xz\n▁") for _ in range(rng.randint(0, 30)))
        assert counts.of(text)[1] == len(coder.encode(text).ids), text
