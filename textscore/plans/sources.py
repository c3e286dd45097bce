"""Queries over sources and sinks: tables go out to files and come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from textscore.operators import metrics
from textscore.functions.hashing import key_to_int
from textscore.operators.sampling import filter_columns, filter_load, reduce_per_category
from textscore.operators.tokens import corpus_text_iter, word_counts, word_lists
from textscore.plans import views
from textscore.plans.registry import query
from textscore.plans.tokens import trained
from textscore.plans.views_sql import WORD, h, key, number
from textscore.session import scratch_path
from textscore.sources.schemas import REVIEW_SCHEMA
from textscore.sources import readers, writers

SOURCES = [f"src{i}" for i in range(20)]
ARRAY_BYTES = 16 << 20
VOCAB_WORDS = 100_000


def _review_files(spark, d, suffix: str, **options) -> str:
    path = scratch_path(spark, "reviews")
    rows = views.reviews(spark, d).select("reviewText", "overall", F.concat("type", F.lit(suffix)).alias("file"))
    rows.write.options(**options).partitionBy("file").json(path)
    return path


_REVIEWS = "SELECT reviewText, overall::DOUBLE AS overall, type FROM v_reviews"


@query("load_reviews", _REVIEWS)
def load_reviews(spark, d):
    return readers.load_reviews(spark, [_review_files(spark, d, ".json")], REVIEW_SCHEMA, arrays=False).drop("file")


@query("load_reviews_jsonl", _REVIEWS)
def load_reviews_jsonl(spark, d):
    return readers.load_reviews_jsonl(spark, [_review_files(spark, d, "-5core.json")], schema=REVIEW_SCHEMA).drop("file")


@query("load_reviews_arrays", _REVIEWS)
def load_reviews_arrays(spark, d):
    """Each category as JSON arrays of bounded size, as in the default form."""
    return readers.load_reviews(spark, [_array_files(spark, d)], REVIEW_SCHEMA).drop("file", "part")


def _array_files(spark, d) -> str:
    """A folder for each category; its rows are dealt by their ids over arrays of about ``ARRAY_BYTES`` of text, a file each."""
    path = scratch_path(spark, "reviews")
    rows = views.reviews(spark, d).withColumn("file", F.concat("type", F.lit(".json")))
    size = F.sum(F.coalesce(F.octet_length("reviewText"), F.lit(0)) + 32)
    parts = rows.groupBy("file").agg(F.ceil(size / ARRAY_BYTES).alias("parts"))  # a row for each category
    dealt = rows.join(parts, "file").withColumn("part", F.pmod(F.xxhash64("row_id"), "parts"))
    arrays = dealt.groupBy("file", "part").agg(F.to_json(F.collect_list(F.struct("reviewText", "overall"))).alias("value"))
    arrays.write.partitionBy("file", "part").text(path)
    return path


_ASIN = "'B' || (row_id % 97)"


@query("load_reviews_all_columns", f"""
    SELECT reviewText, overall::DOUBLE AS overall, type, {_ASIN} AS asin, row_id % 3 = 0 AS verified,
           CASE WHEN row_id % 5 = 0 THEN NULL ELSE (row_id % 11)::VARCHAR END AS vote FROM v_reviews WHERE type = 'src3'""")
def load_reviews_all_columns(spark, d):
    """Fields besides text and score, picked by one of them afterwards."""
    path = scratch_path(spark, "reviews")
    rows = views.reviews(spark, d).withColumns({
        "asin": F.concat(F.lit("B"), F.col("row_id") % 97), "verified": F.col("row_id") % 3 == 0,
        "vote": F.when(F.col("row_id") % 5 != 0, (F.col("row_id") % 11).cast("string")),
        "file": F.concat("type", F.lit(".json"))})
    rows.drop("type", "row_id").write.partitionBy("file").json(path)
    loaded = readers.load_reviews(spark, [path], arrays=False)
    return filter_columns(loaded, {"type": "src3"}).select("reviewText", "overall", "type", "asin", "verified", "vote")


def _sorted_files(spark, d, suffix: str, **options) -> str:
    """One file for each category with its rows in the order of their ids."""
    path = scratch_path(spark, "reviews")
    rows = views.reviews(spark, d).withColumn("file", F.concat("type", F.lit(suffix)))
    rows = rows.repartition("file").sortWithinPartitions("file", "row_id").select("reviewText", "overall", "file")
    rows.write.options(**options).partitionBy("file").json(path)
    return path


@query("load_reviews_jsonl_first", _REVIEWS + " QUALIFY row_number() OVER (PARTITION BY type ORDER BY row_id) <= 7")
def load_reviews_jsonl_first(spark, d):
    return readers.load_reviews_jsonl(spark, [_sorted_files(spark, d, "-5core.json")], nrows_per_type=7, schema=REVIEW_SCHEMA).drop("file")


@query("load_reviews_indexed", """
    SELECT reviewText, overall::DOUBLE AS overall, type, row_number() OVER (ORDER BY type || '-', row_id) - 1 AS row_id FROM v_reviews""")
def load_reviews_indexed(spark, d):
    return readers.load_reviews_jsonl(spark, [_sorted_files(spark, d, "-5core.json")], schema=REVIEW_SCHEMA, index="row_id").drop("file")


def _essay_file(spark, d) -> str:
    path = scratch_path(spark, "essays")
    views.essays_raw(spark, d).write.csv(
        path, sep="\t", header=True, encoding="ISO-8859-1", quote='"', escape='"', quoteAll=True
    )
    return path


@query("load_essays", "SELECT essay_id, essay_set, essay, domain1_score, domain2_score, 'train' AS split FROM v_essays")
def load_essays(spark, d):
    return readers.load_essays(spark, train=_essay_file(spark, d)).select(
        "essay_id", "essay_set", "essay", "domain1_score", "domain2_score", "split"
    )


@query("load_essays_splits", f"""
    SELECT essay_id, essay_set, domain1_score, domain2_score, 'train' AS split FROM v_essays
    UNION ALL
    SELECT {number('essay_id')}, {number('essay_set')}, {number('domain1_score')}, {number('domain2_score')}, s.split
    FROM v_essays_raw CROSS JOIN (VALUES ('valid'), ('test')) s(split)""")
def load_essays_splits(spark, d):
    path = _essay_file(spark, d)
    return readers.load_essays(spark, path, path, path).select("essay_id", "essay_set", "domain1_score", "domain2_score", "split")


@query("load_essays_json", "SELECT *, 'valid' AS split FROM v_essays_clean")
def load_essays_json(spark, d):
    path = scratch_path(spark, "essays")
    views.essays_raw(spark, d).write.json(path)
    return readers.load_essays_json(spark, {"valid": path}, arrays=False)


@query("load_essays_json_arrays", "SELECT *, 'valid' AS split FROM v_essays_clean")
def load_essays_json_arrays(spark, d):
    """The default form: JSON arrays, each dealt over tasks as its size asks for."""
    path = scratch_path(spark, "essays")
    rows = views.essays_raw(spark, d)
    size = rows.agg(F.sum(F.octet_length("essay") + 64)).first()[0] or 0
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("essay_id"), F.lit(1 + size // ARRAY_BYTES)))
    arrays = dealt.groupBy("part").agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    arrays.write.partitionBy("part").text(path)
    return readers.load_essays_json(spark, {"valid": path})


@query("read_gzip_jsonl", "SELECT reviewText, overall::DOUBLE AS overall FROM v_reviews")
def read_gzip_jsonl(spark, d):
    path = scratch_path(spark, "reviews")
    views.reviews(spark, d).select("reviewText", "overall").write.option("compression", "gzip").json(path)
    return readers.read_gzip_jsonl(spark, path, schema=REVIEW_SCHEMA)


@query("read_gzip_jsonl_limit", """
    SELECT reviewText, overall::DOUBLE AS overall FROM v_reviews QUALIFY row_number() OVER (ORDER BY row_id) <= 150""")
def read_gzip_jsonl_limit(spark, d):
    path = scratch_path(spark, "reviews")
    rows = views.reviews(spark, d).repartitionByRange(4, "row_id").sortWithinPartitions("row_id")
    rows.select("reviewText", "overall").write.option("compression", "gzip").json(path)
    return readers.read_gzip_jsonl(spark, path, limit=150, schema=REVIEW_SCHEMA)


_FILTERED = "v_reviews WHERE type = 'src3' AND overall BETWEEN 4 AND 5"


@query("filter_load_index", f"SELECT row_id FROM {_FILTERED} ORDER BY {key('row_id', 1)} LIMIT 3")
def filter_load_index(spark, d):
    return filter_load(views.review_corpus(spark, d), "src3", score=[4, 5], n=3, fmt="index", seed=1)


def _word_ids(rows):
    return word_lists(rows, "reviewText").withColumn("ids", F.transform("words", lambda w: (key_to_int(F.md5(w)) % 1000).cast("int")))


_IDS = f"array_to_string(list_transform(regexp_extract_all(lower(reviewText), '{WORD}'), lambda w: {h('w')} % 1000), ' ') AS ids"


@query("filter_load_encoding", f"""
    SELECT row_id, reviewText, overall, {_IDS} FROM {_FILTERED} ORDER BY {key('row_id', 1)} LIMIT 3""")
def filter_load_encoding(spark, d):
    rows = filter_load(views.review_corpus(spark, d), "src3", score=[4, 5], n=3, fmt="encoding", seed=1, encoder=_word_ids)
    return rows.select("row_id", "reviewText", "overall", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("filter_load_train", f"SELECT row_id, {_IDS}, overall - 1 AS y FROM {_FILTERED} ORDER BY {key('row_id', 1)} LIMIT 3")
def filter_load_train(spark, d):
    rows = filter_load(views.review_corpus(spark, d), "src3", score=[4, 5], n=3, fmt="train", seed=1, encoder=_word_ids)
    return rows.select("row_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), "y")


@query("vocab_load_json", "SELECT DISTINCT word, n, length(word)::INT AS rank_length FROM v_word_counts")
def vocab_load_json(spark, d):
    """Tokenizer files of at most about ``VOCAB_WORDS`` words each, whose vocabulary is the words of the corpus with their counts as ids."""
    vocab, merges = readers.vocab_load(spark, _vocab_files(spark, d))
    made = merges.select(F.concat("left", "right").alias("token"), F.length(F.concat("left", "right")).alias("rank_length"))
    return vocab.join(made, "token").select(F.col("token").alias("word"), F.col("id").cast("bigint").alias("n"), "rank_length")


def _vocab_files(spark, d) -> str:
    path = scratch_path(spark, "tokenizer") + ".json"
    words = word_counts(views.documents(spark, d), "text").where(F.length("word") > 1)
    parts = max(1, -(-words.count() // VOCAB_WORDS))
    pairs = F.struct(F.map_from_entries(F.collect_list(F.struct("word", F.col("n").cast("int")))).alias("vocab"),
                     F.collect_list(F.concat_ws(" ", F.substring("word", 1, 1), F.col("word").substr(F.lit(2), F.length("word")))).alias("merges"))
    files = words.groupBy(F.pmod(F.xxhash64("word"), F.lit(parts)).alias("part")).agg(F.to_json(F.struct(pairs.alias("model"))).alias("value"))
    files.write.partitionBy("part").text(path)
    return path


@query("category_allowlist", "SELECT row_id, type, overall FROM v_reviews WHERE type IN ('src1', 'src3', 'src12')")
def category_allowlist(spark, d):
    rows = views.reviews(spark, d).select("row_id", "type", "overall")
    return readers.category_allowlist(rows, ["src1", "src3", "src12"], known=SOURCES)


@query("reduce_per_category", """
    SELECT row_id, type, overall FROM v_reviews
    QUALIFY row_number() OVER (PARTITION BY type ORDER BY row_id) <= 20""")
def reduce_categories(spark, d):
    return reduce_per_category(views.reviews(spark, d).select("row_id", "type", "overall"), 20, "type", "row_id")


@query("corpus_text_export", "SELECT regexp_replace(reviewText, '[\\r\\n]+', ' ', 'g') AS value FROM v_reviews")
def corpus_text_export(spark, d):
    path = scratch_path(spark, "text")
    writers.corpus_text_export(views.reviews(spark, d), "reviewText", path)
    return spark.read.text(path)


@query("corpus_text_iter", "SELECT reviewText FROM v_reviews WHERE reviewText IS NOT NULL")
def text_iter(spark, d):
    return corpus_text_iter(views.reviews(spark, d), "reviewText")


@query("write_metrics", """
    SELECT round(100.0::DOUBLE * sum(correct) / (ceil(any_value(all_rows) / 16.0) * 16), 6) AS accuracy,
           round(count(*) / sum((correct::DOUBLE / total + correct::DOUBLE / all_rows)
                 / (2 * (correct::DOUBLE / total) * (correct::DOUBLE / all_rows))), 6) AS f1
    FROM v_class_table""")
def write_metrics(spark, d):
    path = scratch_path(spark, "metrics")
    report = metrics.metrics_report(views.predictions(spark, d), views.REVIEW_CLASSES)
    writers.write_metrics(report, path)
    back = spark.read.schema("accuracy double, f1 double").json(path)
    return back.select(F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"))


@query("append_metric_log", """
    SELECT type AS run, 'accuracy' AS tag, round(100 * avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0 END), 6) AS value,
           batch_id::BIGINT AS step FROM v_predictions GROUP BY type, batch_id
    UNION ALL
    SELECT type, 'correct', round(sum(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0 END), 6), batch_id::BIGINT
    FROM v_predictions GROUP BY type, batch_id""")
def append_metric_log(spark, d):
    path = scratch_path(spark, "log")
    hit = (F.col("y_true") == F.col("y_pred")).cast("double")
    per_batch = views.predictions(spark, d).groupBy(F.col("type").alias("run"), F.col("batch_id").alias("step"))
    for tag, value in (("accuracy", 100 * F.avg(hit)), ("correct", F.sum(hit))):
        rows = per_batch.agg(F.round(value, 6).alias("value")).withColumn("tag", F.lit(tag))
        writers.append_metric_log(rows, path)
    return spark.read.schema("tag string, value double, step bigint, run string").parquet(path)


@query("vocab_save_load")
def vocab_save_load(spark, d):
    path = scratch_path(spark, "vocab")
    writers.vocab_save(*trained(spark, d), path)
    vocab, merges = readers.vocab_load(spark, path)
    made = merges.select(F.concat("left", "right").alias("token"), "rank")
    return vocab.join(made, "token", "left")
