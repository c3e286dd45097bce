"""Vocabularies by name, by default, and trained where none is there."""

from dataclasses import replace

import pytest

from textscore.functions.text import ENTITY_TAGS
from textscore.operators.bpe import bpe_train, encode_text
from textscore.sources import vocabularies
from textscore.sources.vocabularies import ESSAYS, REVIEWS, find_vocabulary, load_or_train
from textscore.sources.writers import vocab_save

TEXTS = ["Low lower lowest", "newer Newest wider @CAPS1 widest", "low new wide", None, ""]


@pytest.fixture()
def corpus(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, x string")
    asked = []

    def texts():
        asked.append(1)
        return rows

    texts.asked = asked
    return texts


def small(kind, size=40):
    return replace(kind, vocab_size=size)


def content(found):
    return sorted(map(tuple, found.vocab.collect())), sorted(map(tuple, found.merges.collect()))


def test_a_missing_name_is_trained_once_and_kept(spark, corpus, tmp_path):
    root, kind = str(tmp_path), small(REVIEWS)
    first = load_or_train(spark, root, kind, corpus, "x", "own")
    assert (first.name, first.trained, corpus.asked) == ("own", True, [1])
    vocab, merges = bpe_train(corpus(), "x", 40)
    assert content(first) == (sorted(map(tuple, vocab.collect())), sorted(map(tuple, merges.collect())))
    again = load_or_train(spark, root, kind, corpus, "x", "own")
    assert (again.name, again.trained, len(corpus.asked)) == ("own", False, 2) and content(again) == content(first)


def test_a_missing_name_falls_back_to_the_default(spark, corpus, tmp_path):
    root, kind = str(tmp_path), small(REVIEWS)
    default = load_or_train(spark, root, kind, corpus, "x")
    assert (default.name, default.trained) == ("reviews_tokenizer", True)
    other = load_or_train(spark, root + "/", small(REVIEWS, 60), corpus, "x", "missing")
    assert (other.name, other.trained, len(corpus.asked)) == ("reviews_tokenizer", False, 1) and content(other) == content(default)
    assert find_vocabulary(spark, root, kind, "missing") is None


def test_kinds_keep_apart_and_train_in_their_own_way(spark, corpus, tmp_path):
    load_or_train(spark, str(tmp_path), small(REVIEWS), corpus, "x")
    essays = load_or_train(spark, str(tmp_path), small(ESSAYS, 60), corpus, "x")
    tokens = {t for t, _ in content(essays)[0]}
    assert essays.trained and essays.name == "essays_tokenizer" and set(ENTITY_TAGS) <= tokens and {"L", "N"} <= tokens
    reviews = load_or_train(spark, str(tmp_path), small(REVIEWS), corpus, "x")
    assert not {"L", "N"} & {t for t, _ in content(reviews)[0]}
    ids = encode_text(corpus(), "x", reviews.vocab, reviews.merges).select("ids").collect()
    assert len(ids) == len(TEXTS)


def test_half_written_is_missing_and_unreadable_fails(spark, corpus, tmp_path):
    root, kind = str(tmp_path), small(REVIEWS)
    vocab, merges = bpe_train(corpus(), "x", 40)
    vocab_save(vocab, merges, f"{root}/reviews/own")
    (tmp_path / "reviews/own/merges/_SUCCESS").unlink()
    assert find_vocabulary(spark, root, kind, "own") is None
    assert load_or_train(spark, root, kind, corpus, "x", "own").trained
    for file in (tmp_path / "reviews/own/vocab").glob("*.parquet"):
        file.write_bytes(b"no parquet")
    for crc in (tmp_path / "reviews/own/vocab").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception):
        content(load_or_train(spark, root, kind, corpus, "x", "own"))


def test_a_tokenizer_file_is_found(spark, corpus, tmp_path):
    (tmp_path / "essays").mkdir()
    (tmp_path / "essays/mine.json").write_text('{"model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]}}')
    found = load_or_train(spark, str(tmp_path), ESSAYS, corpus, "x", "mine")
    assert not found.trained and not corpus.asked
    assert content(found) == ([("a", 0), ("ab", 2), ("b", 1)], [(0, "a", "b")])
    assert vocabularies.REVIEWS.vocab_size == vocabularies.ESSAYS.vocab_size == 1000
