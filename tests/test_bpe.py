import json
import random
import re
from collections import Counter

import pytest

from textscore.functions.text import ENTITY_TAGS, PADDING_TOKEN
from textscore.operators import bpe, pair_index, tokens

tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    "aaa aaaa aaaaa aa a", "low lower lowest newer wider", "İstanbul ΟΔΟΣ ŒUVRE", "a<b & \"c\" <PAD> x...<PAD>!!",
    "@CAPS1 met @DRIVER at @@PERSON12.", "naïve café — “quoted”", "\U0001F600\U0001F600 ok\U0001F600", "",
    "  spaces \t\n everywhere  ", "abc abcd bcd ab cd abcabc " * 5, "1,000.50 under_score __x__", "٣٤٥ हिन्दी",
]


def public(texts, size, special, lowercase):
    from tokenizers import Tokenizer
    from tokenizers.models import BPE
    from tokenizers.normalizers import Lowercase
    from tokenizers.pre_tokenizers import Whitespace
    from tokenizers.trainers import BpeTrainer

    tok = Tokenizer(BPE())
    tok.pre_tokenizer = Whitespace()
    if lowercase:
        tok.normalizer = Lowercase()
    tok.train_from_iterator(texts, trainer=BpeTrainer(special_tokens=list(special), vocab_size=size, show_progress=False))
    return tok


def made_up(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcd", k=rnd.randint(1, 9))) for _ in range(60)]
    return [" ".join(rnd.choices(words, k=30)) for _ in range(20)]


def rules(vocab, merges):
    return (
        {r.token: r.id for r in vocab.collect()},
        [(r.left, r.right) for r in merges.orderBy("rank").collect()],
    )


CASES = [
    (TEXTS, 160, (PADDING_TOKEN,), True), (TEXTS, 200, (PADDING_TOKEN, *ENTITY_TAGS), False),
    (made_up(1), 120, (PADDING_TOKEN,), True), (made_up(2), 5000, (), False),
]


@pytest.mark.parametrize("texts,size,special,lowercase", CASES)
def test_training_and_encoding_equal_the_public_package(spark, texts, size, special, lowercase):
    tok = public(texts, size, special, lowercase)
    model = json.loads(tok.to_str())["model"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    vocab, merges = bpe.bpe_train(df, "text", size, special, lowercase)
    got_vocab, got_merges = rules(vocab, merges)
    assert got_vocab == model["vocab"]
    assert got_merges == [tuple(m) for m in model["merges"]]

    unseen = spark.createDataFrame(list(enumerate(texts + ["zebra azb Qq", "İab @CAPS2"])), "id int, text string")
    encoded = bpe.encode_text(unseen, "text", vocab, merges, special, lowercase)
    for r in encoded.collect():
        want = tok.encode(r.text)
        assert r.ids == want.ids and r.tokens == want.tokens
        if all(set(ch.lower() if lowercase else ch) <= set(got_vocab) for ch in r.text if not ch.isspace()):
            assert [tuple(o) for o in r.offsets] == want.offsets


def test_characters_outside_the_alphabet_drop_out(spark):
    df = spark.createDataFrame([("ab ab ab",)], "text string")
    vocab, merges = bpe.bpe_train(df, "text", 10)
    row = bpe.encode_text(spark.createDataFrame([("azb",)], "text string"), "text", vocab, merges).first()
    assert row.tokens == ["ab"] and [tuple(o) for o in row.offsets] == [(0, 3)]


def test_offsets_point_into_the_original_text(spark):
    df = spark.createDataFrame([("İx İx ix",)], "text string")
    vocab, merges = bpe.bpe_train(df, "text", 30)
    row = bpe.encode_text(df, "text", vocab, merges).first()
    for token, (start, end) in zip(row.tokens, row.offsets):
        assert row.text[start:end].lower() == token


def test_null_and_blank_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("   ",), ("ab",)], "text string")
    vocab, merges = bpe.bpe_train(df, "text", 10)
    got = [r.tokens for r in bpe.encode_text(df, "text", vocab, merges, offsets=False).collect()]
    assert got == [[], [], [], ["ab"]]


def slow_rules(texts, size):
    """Merges by counting every pair of every word again before each."""
    words = Counter(w for t in texts for w in re.findall(r"\w+|[^\w\s]+", t))
    words = {tuple(w): n for w, n in words.items()}
    order = {c: i for i, c in enumerate(sorted({c for w in words for c in w}))}
    tokens, merges = set(order), []
    while len(tokens) < size:
        counts = Counter()
        for w, n in words.items():
            for pair in zip(w, w[1:]):
                counts[pair] += n
        if not counts:
            break
        a, b = min(counts, key=lambda p: (-counts[p], order[p[0]], order[p[1]]))
        merges.append((a, b))
        tokens.add(a + b)
        order.setdefault(a + b, len(order))
        merged = Counter()
        for w, n in words.items():
            out, i = [], 0
            while i < len(w):
                if w[i:i + 2] == (a, b):
                    out.append(a + b)
                    i += 2
                else:
                    out.append(w[i])
                    i += 1
            merged[tuple(out)] += n
        words = merged
    return merges


@pytest.mark.parametrize("limits", [{}, {"MAX_RUNS": 20}, {"MAX_GENERATIONS": 3}, {"MAX_PAIRS": 4}, {"FIRST_PAIRS": 1}, {"WORDS_PER_PART": 5},
                                    {"MAX_PAIRS": 9, "FIRST_PAIRS": 5, "RUNS_PER_TASK": 3}])
def test_limits_change_the_work_and_not_the_merges(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(pair_index, name, value)
    texts = made_up(3)[:4]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    assert rules(*bpe.bpe_train(df, "text", 22))[1] == slow_rules(texts, 21)


def test_pair_counts(spark):
    words = spark.createDataFrame([("aaa", 2), ("ab", 3), ("x", 9)], "word string, n bigint")
    got = {(r.left, r.right): r.n for r in tokens.pair_counts(words).collect()}
    assert got == {("a", "a"): 4, ("a", "b"): 3}


def test_pad_truncate(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([4],), ([],)], "ids array<int>")
    assert [r.ids for r in tokens.pad_truncate(df, "ids", 2).collect()] == [[1, 2], [4, 0], [0, 0]]
    assert [r.ids for r in tokens.pad_truncate(df, "ids", "max").collect()] == [[1, 2, 3], [4, 0, 0], [0, 0, 0]]


def test_alphabet_numbers_specials_first(spark):
    words = spark.createDataFrame([("ba",), ("cb",)], "word string")
    got = {r.token: r.id for r in tokens.alphabet(words, ("<PAD>", "@X")).collect()}
    assert got == {"<PAD>": 0, "@X": 1, "a": 2, "b": 3, "c": 4}


def test_pretoken_offsets(spark):
    df = spark.createDataFrame([(1, "  Hi, you…  ok")], "id int, text string")
    got = [(r.word, r.start, r.end) for r in tokens.pretoken_offsets(df, "id", "text").orderBy("pos").collect()]
    assert got == [("hi", 2, 4), (",", 4, 5), ("you", 6, 9), ("…", 9, 10), ("ok", 12, 14)]


def test_no_row_python_and_no_shuffle_in_encoding(spark):
    df = spark.createDataFrame([("ab ab",)], "text string")
    vocab, merges = bpe.bpe_train(df, "text", 10)
    plan = bpe.encode_text(df, "text", vocab, merges)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Exchange" not in plan and "BatchEvalPython" not in plan


def test_rounds_merge_several_pairs_and_read_fewer_words(spark, monkeypatch):
    monkeypatch.setattr(pair_index, "MAX_RUNS", 1500)
    rnd = random.Random(6)
    words = ["".join(rnd.choices("abcdefghijklmnopqrst", [30 - i for i in range(20)], k=rnd.randint(1, 9))) for _ in range(8000)]
    df = spark.createDataFrame([(w, 1 + i % 9) for i, w in enumerate(dict.fromkeys(words))], "word string, n bigint")
    progress = []
    _, merges = bpe.merge_rules(df.coalesce(2), 500, (), progress)
    read, changed = [p[1] for p in progress], [p[2] for p in progress]
    assert len(progress) < len(merges) / 4, progress
    assert all(c <= r for r, c in zip(read, changed))
    assert max(read[-3:]) < 0.7 * max(read[:3]) and sum(read) < 0.5 * len(progress) * df.count()


def test_too_few_symbols_fail_before_training(spark):
    df = spark.createDataFrame([(1, "ab\U0010FFFF ab")], "id int, text string")
    with pytest.raises(ValueError, match="symbols above the alphabet"):
        bpe.bpe_train(df, "text", 50)
    assert bpe.bpe_train(df, "text", 3)[0].count() >= 3


def test_a_vocabulary_of_any_size_is_not_sent(spark, monkeypatch):
    df = spark.createDataFrame([(1, "low lower")], "id int, text string")
    vocab, merges = bpe.bpe_train(df, "text", 12)
    monkeypatch.setattr(bpe, "MAX_VOCABULARY", 5)
    with pytest.raises(ValueError, match="too large"):
        bpe.encode_text(df, "text", vocab, merges)


def test_offsets_of_pretokens_leave_the_text_behind(spark):
    """A row per pretoken must not carry the whole text: cutting each out of it takes time with the square of its length."""
    df = spark.createDataFrame([(1, "  Hi,\x1c İyou…  ok"), (2, None)], "id int, text string")
    found = tokens.pretoken_offsets(df, "id", "text")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("Generate")]
    assert "substring" not in plan and "text#" not in above
    assert [(r.word, r.start, r.end) for r in found.orderBy("pos").collect()] == [
        ("hi", 2, 4), (",\x1c", 4, 6), ("i\u0307you", 7, 11), ("…", 11, 12), ("ok", 14, 16)]


def test_a_round_of_training_shuffles_runs_only(spark, monkeypatch):
    df = spark.createDataFrame([("ab" * (1 + i % 5) + "cde"[i % 3], 1 + i) for i in range(40)], "s string, n bigint")
    table = pair_index.Words(df)
    table.merge([("ab", "\U000F0000")])
    plan = table.runs(["bc", "\U000F0000\U000F0000"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "wid" not in plan
    assert all("ab" not in r.s and len(r.s) > 1 for r in table.now().collect())
    table.drop()


def test_pieces_of_words_are_held_in_few_bytes():
    letters = {ch: i for i, ch in enumerate("abcdefghij")}
    held = bpe.PieceTable(letters, [], set(), True).pieces("abcdefghij" * 3)
    assert len(held) == 12 * 30 and isinstance(held, bytes)


def test_hashed_ids(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), ([],), (None,), (["é"],)], "words array<string>")
    want = lambda w: int(__import__("hashlib").md5(w.encode()).hexdigest()[:8], 16) % 7
    assert [r.ids for r in tokens.hashed_ids(df.coalesce(1), "words", 7).collect()] == [
        [want("a"), want("b"), want("a")], [], None, [want("é")]]


def test_encoded_batches_leave_the_task_in_parts(spark):
    df = spark.createDataFrame([(i, f"{'ab cd ' * 75_000}x{i}" if i % 2 else None) for i in range(7)], "id int, text string").coalesce(1)
    vocab, merges = bpe.bpe_train(spark.createDataFrame([("ab cd x0123456",)], "text string"), "text", 14)
    encoded = bpe.encode_text(df, "text", vocab, merges).selectExpr("id", "size(ids) n", "element_at(tokens, -1) last", "element_at(offsets, -1).end stop")
    assert "ArrowEvalPython" in (plan := encoded._jdf.queryExecution().executedPlan().toString()) and ", 251" in plan  # an iterator of batches
    got = {r.id: (r.n > 150_000, r.last, r.stop) for r in encoded.where("n > 0").collect()}
    assert got == {i: (True, str(i), 450_002) for i in (1, 3, 5)} and encoded.count() == 7
