"""Queries over tokens, vocabularies and batches."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textscore.functions.text import ENTITY_TAGS, PADDING_TOKEN
from textscore.operators import batches, bpe, tokens
from textscore.plans import views
from textscore.plans.registry import query
from textscore.plans.views_sql import WORD, key
from textscore.session import made_once, scratch_path, via_table
from textscore.sources import readers, vocabularies, writers

VOCAB_SIZE = 1000
SPECIAL = (PADDING_TOKEN, *ENTITY_TAGS)


def trained(spark, d):
    """The review vocabulary of a data folder; trained once per session."""
    return made_once(
        spark, ("vocab", views.stamp(spark, d, "documents")), lambda: bpe.bpe_train(views.reviews(spark, d), "reviewText", VOCAB_SIZE)
    )


def encoded_reviews(spark, d):
    """Reviews with ids, tokens and offsets, encoded once and kept as a table."""
    return made_once(spark, ("encoded", views.stamp(spark, d, "documents")), lambda: via_table(
        bpe.encode_text(views.reviews(spark, d), "reviewText", *trained(spark, d)), "encoded"
    ))


def _joined(ids):
    return F.array_join(F.col(ids).cast("array<string>"), " ").alias("ids")


@query("normalize_lower", "SELECT row_id, lower(reviewText) AS reviewText FROM v_reviews")
def normalize_lower(spark, d):
    return tokens.normalize_lower(views.reviews(spark, d).select("row_id", "reviewText"), "reviewText")


@query("pretokenize", "SELECT doc_id, pos::INT AS pos, token AS word FROM v_tokens")
def pretokenize(spark, d):
    return tokens.pretokenize(views.documents(spark, d), "text", keep=["doc_id"])


@query("pretoken_offsets", """
    SELECT doc_id, pos, lower(p) AS word, "end" - length(p)::INT AS start, "end" FROM v_pieces WHERE NOT g""")
def pretoken_offsets(spark, d):
    return tokens.pretoken_offsets(views.documents(spark, d), "doc_id", "text")


_COUNTS = """
    WITH counts AS (SELECT token AS word, count(*) AS n FROM v_tokens GROUP BY token),
    symbols AS (SELECT word, n, string_split(word, '') AS s FROM counts)
"""


@query("word_counts", _COUNTS + "SELECT word, n FROM counts")
def word_counts(spark, d):
    return tokens.word_counts(views.documents(spark, d), "text")


def _alphabet(special: tuple) -> str:
    first = " UNION ALL ".join(f"SELECT '{t}' AS token, {i} AS id" for i, t in enumerate(special))
    return _COUNTS + f"""
    , chars AS (SELECT DISTINCT unnest(s) AS c FROM symbols),
    vocab AS ({first} UNION ALL
        SELECT c, (row_number() OVER (ORDER BY c COLLATE C) + {len(special) - 1})::INT FROM chars)
    """.replace(" COLLATE C", "")


@query("alphabet", _alphabet((PADDING_TOKEN,)) + "SELECT token, id FROM vocab")
def alphabet(spark, d):
    return tokens.alphabet(tokens.word_counts(views.documents(spark, d), "text"))


@query("special_tokens", _alphabet(SPECIAL)
       + f"SELECT token, id FROM vocab WHERE token IN ({', '.join(repr(t) for t in SPECIAL)})")
def special_tokens(spark, d):
    vocab = tokens.alphabet(tokens.word_counts(views.documents(spark, d), "text"), SPECIAL)
    return tokens.special_tokens(vocab, SPECIAL)


@query("vocab_size", _alphabet((PADDING_TOKEN,)) + "SELECT count(*) AS vocab_size FROM vocab")
def vocab_size(spark, d):
    return tokens.vocab_size(tokens.alphabet(tokens.word_counts(views.documents(spark, d), "text")))


@query("pair_counts", _COUNTS + """
    SELECT "left", "right", sum(n)::BIGINT AS n FROM (
        SELECT unnest(s[:-2]) AS "left", unnest(s[2:]) AS "right", n FROM symbols WHERE len(s) >= 2)
    GROUP BY "left", "right" """)
def pair_counts(spark, d):
    return tokens.pair_counts(tokens.word_counts(views.documents(spark, d), "text"))


@query("bpe_train")
def bpe_train(spark, d):
    vocab, merges = trained(spark, d)
    rules = merges.withColumn("token", F.concat("left", "right"))
    return vocab.join(rules, "token", "left").select("token", "id", "rank", "left", "right")


def _encoded(spark, d):
    vocab, merges = trained(spark, d)
    return bpe.encode_text(views.reviews(spark, d).select("row_id", "reviewText"), "reviewText", vocab, merges)


SHORT_VOCAB = 100


# A short vocabulary can be trained and applied in SQL too: the words are rewritten
# merge by merge, with one code point per symbol as in the library.
def _trained_sql(tokens: str, size: int, specials: int = 1) -> str:
    return f"""
    WITH RECURSIVE counts AS (SELECT token AS word, count(*) AS n FROM ({tokens}) GROUP BY token),
    chars AS (SELECT DISTINCT unnest(string_split(word, '')) AS c FROM counts),
    goal AS (SELECT {size} - {specials} - count(*) AS merges FROM chars),
    w AS (
        SELECT 0 AS step, word, word AS s, n, '' AS pair FROM counts
        UNION ALL
        SELECT step + 1, word, replace(s, b.pair, chr(983040 + step)), n, b.pair
        FROM w, (SELECT pair FROM (
                     SELECT unnest(list_transform(range(1, length(s)), lambda i: s[i:i + 1])) AS pair, n
                     FROM w WHERE length(s) >= 2)
                 GROUP BY pair ORDER BY sum(n) DESC, pair LIMIT 1) b
        WHERE step < (SELECT merges FROM goal)),
    m AS (SELECT DISTINCT step, pair FROM w WHERE step > 0),
    d AS (
        SELECT (SELECT max(step) FROM m) AS k, step, pair[1] AS l, pair[2] AS r FROM m
        UNION ALL
        SELECT k - 1, d.step, replace(l, chr((983039 + k)::INT), m.pair), replace(r, chr((983039 + k)::INT), m.pair)
        FROM d JOIN m ON m.step = d.k),
    rules AS (SELECT step, l, r FROM d WHERE k = 0),
    symbols AS (
        SELECT c AS symbol, row_number() OVER (ORDER BY c) AS id, c AS token FROM chars
        UNION ALL
        SELECT chr((983039 + step)::INT), (SELECT count(*) FROM chars) + step, l || r FROM rules),
    coded AS (
        SELECT word, j, id, length(token) AS n, sum(length(token)) OVER (PARTITION BY word ORDER BY j) AS e
        FROM (SELECT word, unnest(string_split(s, '')) AS symbol, generate_subscripts(string_split(s, ''), 1) AS j
              FROM w WHERE step = (SELECT merges FROM goal)) JOIN symbols USING (symbol))
"""


_SHORT = _trained_sql("SELECT token FROM v_tokens", SHORT_VOCAB)


def _short(spark, d):
    return made_once(
        spark, ("short vocab", views.stamp(spark, d, "documents")), lambda: bpe.bpe_train(views.reviews(spark, d), "reviewText", SHORT_VOCAB)
    )


def _encoded_short(spark, d):
    return bpe.encode_text(views.reviews(spark, d).select("row_id", "reviewText"), "reviewText", *_short(spark, d))


_MERGES = _SHORT + 'SELECT (step - 1)::INT AS rank, l AS "left", r AS "right" FROM rules'


@query("bpe_merges", _MERGES)
def bpe_merges(spark, d):
    return _short(spark, d)[1]


ESSAY_VOCAB = 180
_ESSAY_TOKENS = f"SELECT unnest(regexp_extract_all(essay, '{WORD}')) AS token FROM v_essays"


@query("bpe_merges_essays", _trained_sql(_ESSAY_TOKENS, ESSAY_VOCAB, len(SPECIAL)) + """
    SELECT (step - 1)::INT AS rank, l AS "left", r AS "right" FROM rules""")
def bpe_merges_essays(spark, d):
    """The essay vocabulary: entity tags are special tokens and case is kept."""
    return bpe.bpe_train(views.essays(spark, d), "essay", ESSAY_VOCAB, SPECIAL, lowercase=False)[1]


@query("encode_text_short", _SHORT + """,
    words AS (SELECT word, string_agg(id::VARCHAR, ' ' ORDER BY j) AS ids FROM coded GROUP BY word)
    SELECT doc_id AS row_id, string_agg(ids, ' ' ORDER BY pos) AS ids FROM v_tokens JOIN words ON token = word
    GROUP BY doc_id""")
def encode_text_short(spark, d):
    return _encoded_short(spark, d).select("row_id", _joined("ids"))


@query("encode_offsets_short", _SHORT + """
    SELECT doc_id AS row_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1)::INT AS pos, id::INT AS id,
           ("end" - length(p) + e - n)::INT AS start, ("end" - length(p) + e)::INT AS "end"
    FROM v_pieces JOIN coded ON lower(p) = word WHERE NOT g""")
def encode_offsets_short(spark, d):
    rows = _encoded_short(spark, d).select("row_id", F.posexplode(F.arrays_zip("ids", "offsets")).alias("pos", "t"))
    return rows.select("row_id", "pos", F.col("t.ids").alias("id"), "t.offsets.start", "t.offsets.end")


def _saved(spark, d, vocab, merges):
    path = scratch_path(spark, "vocab")
    writers.vocab_save(vocab, merges, path)
    return readers.vocab_load(spark, path)


@query("vocab_save", _alphabet((PADDING_TOKEN,)) + "SELECT token, id FROM vocab")
def vocab_save(spark, d):
    words = tokens.word_counts(views.documents(spark, d), "text")
    return _saved(spark, d, tokens.alphabet(words), _short(spark, d)[1])[0]


@query("vocab_load", _MERGES)
def vocab_load(spark, d):
    return _saved(spark, d, *_short(spark, d))[1]


@query("vocab_load_or_train", _SHORT + """
    SELECT name, trained, (step - 1)::INT AS rank, l AS "left", r AS "right"
    FROM rules CROSS JOIN (VALUES ('own', true), ('own', false), ('reviews_tokenizer', true), ('reviews_tokenizer', false)) c(name, trained)""")
def vocab_load_or_train(spark, d):
    """Asked for by a name that is missing, again by that name, by the default name, and by a name that falls back to it."""
    root, kind = scratch_path(spark, "vocabularies"), replace(vocabularies.REVIEWS, vocab_size=SHORT_VOCAB)
    texts = lambda: views.reviews(spark, d)
    found = [vocabularies.load_or_train(spark, root, kind, texts, "reviewText", name) for name in ("own", "own", None, "missing")]
    return reduce(DataFrame.union, [
        f.merges.select(F.lit(f.name).alias("name"), F.lit(f.trained).alias("trained"), "rank", "left", "right") for f in found])


@query("encode_text")
def encode_text(spark, d):
    return _encoded(spark, d).select(
        "row_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"),
        F.array_join("tokens", " ").alias("tokens"),
    )


@query("encode_text_rejoined", """
    SELECT doc_id AS row_id, regexp_replace(lower(text), '\\s+', '', 'g') AS tokens FROM documents""")
def encode_text_rejoined(spark, d):
    """The pieces of a text in order give the text back, without its blanks."""
    return _encoded(spark, d).select("row_id", F.array_join("tokens", "").alias("tokens"))


@query("encode_offsets")
def encode_offsets(spark, d):
    return _encoded(spark, d).select("row_id", F.posexplode(F.arrays_zip("tokens", "offsets")).alias("pos", "t")).select(
        "row_id", "pos", F.col("t.tokens").alias("token"), "t.offsets.start", "t.offsets.end"
    )


_IDS = "WITH docs AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM v_tokens GROUP BY doc_id)"


@query("pad_truncate", _IDS + """
    SELECT doc_id, array_to_string(list_transform(range(1, 513), lambda i: coalesce(ids[i], 0)), ' ') AS ids FROM docs""")
def pad_truncate(spark, d):
    return tokens.pad_truncate(views.token_docs(spark, d), "ids", 512).select("doc_id", _joined("ids"))


# ---------------------------------------------------------------- batches

_PLACED = _IDS + """,
    placed AS (SELECT doc_id, ids, len(ids) AS n_tokens, row_number() OVER (ORDER BY len(ids), doc_id) - 1 AS pos,
                      count(*) OVER () AS n FROM docs)
"""


@query("length_order", _PLACED + "SELECT doc_id, n_tokens::INT AS n_tokens, pos FROM placed")
def length_order(spark, d):
    return batches.length_order(views.token_docs(spark, d).select("doc_id", "ids"), "ids", "doc_id").select(
        "doc_id", "n_tokens", "pos"
    )


@query("bucket_batches", _PLACED + f"""
    SELECT doc_id, n_tokens::INT AS n_tokens, pos, pos // 16 AS batch_id, {key('pos // 16', 3)} AS batch_key
    FROM placed WHERE pos // 16 < n // 16""")
def bucket_batches(spark, d):
    rows = views.token_docs(spark, d).select("doc_id", "ids")
    return batches.bucket_batches(rows, "ids", "doc_id", shuffle=True, seed=3).drop("ids")


@query("bucket_batches_in_order", _PLACED + """
    SELECT doc_id, n_tokens::INT AS n_tokens, pos, pos // 16 AS batch_id FROM placed""")
def bucket_batches_in_order(spark, d):
    rows = views.token_docs(spark, d).select("doc_id", "ids")
    return batches.bucket_batches(rows, "ids", "doc_id", shuffle=False).drop("ids", "batch_key")


@query("batch_count", """
    SELECT ceil(count(*) / 16.0)::BIGINT AS batches_ceiling, (count(*) // 16)::BIGINT AS batches_full FROM documents""")
def batch_count(spark, d):
    return batches.batch_count(views.documents(spark, d))


_PADDED = _PLACED + """,
    padded AS (
        SELECT doc_id, batch_id, list_transform(range(1, m + 1), lambda i: coalesce(ids[i], 0)) AS ids
        FROM (SELECT *, pos // 16 AS batch_id, max(n_tokens) OVER (PARTITION BY pos // 16) AS m FROM placed))
"""


def _padded(spark, d):
    rows = views.token_docs(spark, d).select("doc_id", "ids")
    placed = batches.bucket_batches(rows, "ids", "doc_id", shuffle=False)
    return batches.pad_to_batch_max(placed, "ids")


@query("pad_to_batch_max", _PADDED + "SELECT doc_id, batch_id, array_to_string(ids, ' ') AS ids FROM padded")
def pad_to_batch_max(spark, d):
    return _padded(spark, d).select("doc_id", "batch_id", _joined("ids"))


@query("padding_mask", _PADDED + """
    SELECT doc_id, batch_id, len(ids) AS n, len(list_filter(ids, lambda i: i = 0)) AS n_masked FROM padded""")
def padding_mask(spark, d):
    masked = batches.padding_mask(_padded(spark, d), "ids")
    return masked.select(
        "doc_id", "batch_id", F.size("mask").cast("bigint").alias("n"),
        F.size(F.filter("mask", lambda m: m)).cast("bigint").alias("n_masked"),
    )


