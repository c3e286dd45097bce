"""Queries over corpus profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from textscore.corpus import reviews_corpus
from textscore.operators import profile, sketches
from textscore.operators.tokens import word_lists
from textscore.plans import views
from textscore.plans.registry import query
from textscore.session import scratch_path, via_table

BLANK = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_WORDS = f"""
    WITH words AS (
        SELECT DISTINCT type, unnest(regexp_split_to_array(reviewText, '{BLANK}+')) AS word FROM v_reviews),
    unique_w AS (
        SELECT coalesce(type, 'all') AS dataset, count(DISTINCT word) AS unique_words
        FROM words GROUP BY GROUPING SETS ((type), ())),
    chars AS (
        SELECT DISTINCT type, unnest(string_split(reviewText, '')) AS ch FROM v_reviews),
    unique_c AS (
        SELECT coalesce(type, 'all') AS dataset, count(DISTINCT ch) AS unique_chars
        FROM chars WHERE ch <> '' GROUP BY GROUPING SETS ((type), ()))
"""


@query("corpus_summary", _WORDS + """,
    sizes AS (
        SELECT coalesce(type, 'all') AS dataset, count(*) AS n_rows, sum(length(reviewText))::DOUBLE / count(*) AS l,
               avg(overall::DOUBLE) AS s
        FROM v_reviews GROUP BY GROUPING SETS ((type), ()))
    SELECT dataset, n_rows, unique_words, unique_chars, round(l, 6) AS mean_length, round(s, 6) AS mean_score
    FROM sizes JOIN unique_w USING (dataset) JOIN unique_c USING (dataset)""")
def corpus_summary(spark, d):
    return _rounded_summary(views.review_corpus(spark, d))


def _rounded_summary(c):
    return (
        profile.corpus_summary(c)
        .withColumn("mean_length", F.round("mean_length", 6)).withColumn("mean_score", F.round("mean_score", 6))
    )


@query("corpus_summary_essays", f"""
    WITH rows AS (SELECT *, essay_set::VARCHAR AS g FROM v_essays_clean),
    words AS (SELECT DISTINCT g, unnest(regexp_split_to_array(essay, '{BLANK}+')) AS word FROM rows),
    unique_w AS (SELECT coalesce(g, 'all') AS dataset, count(DISTINCT word) AS unique_words
                 FROM words GROUP BY GROUPING SETS ((g), ())),
    chars AS (SELECT DISTINCT g, unnest(string_split(essay, '')) AS ch FROM rows),
    unique_c AS (SELECT coalesce(g, 'all') AS dataset, count(DISTINCT ch) AS unique_chars
                 FROM chars WHERE ch <> '' GROUP BY GROUPING SETS ((g), ())),
    sizes AS (SELECT coalesce(g, 'all') AS dataset, count(*) AS n_rows, sum(length(essay))::DOUBLE / count(*) AS l,
                     avg(domain1_score::DOUBLE) AS s FROM rows GROUP BY GROUPING SETS ((g), ()))
    SELECT dataset, n_rows, unique_words, unique_chars, round(l, 6) AS mean_length, round(s, 6) AS mean_score
    FROM sizes JOIN unique_w USING (dataset) JOIN unique_c USING (dataset)""")
def corpus_summary_essays(spark, d):
    return _rounded_summary(views.essays_corpus(views.essays_clean(spark, d)))


def _grown(spark, d):
    """Sketches of the reviews in eight files, three of which were there when the others came."""
    path, folder = scratch_path(spark, "reviews"), scratch_path(spark, "sketches")
    rows = views.reviews(spark, d).withColumn("part", F.pmod(F.xxhash64("row_id"), F.lit(8)))
    rows.select("row_id", "reviewText", "type", "overall", "part").write.partitionBy("part").parquet(path)
    schema = "row_id bigint, reviewText string, type string, overall int, part bigint"

    def read(paths):
        found = spark.read.schema(schema).option("basePath", path).parquet(*paths)
        return reviews_corpus(found.withColumn("file", F.concat(F.lit(f"{path}/part="), F.col("part"))))

    parts = [f"{path}/part={r.part}" for r in spark.read.parquet(path).select("part").distinct().collect()]  # eight at most
    for known in (parts[:3], parts):
        sketches.add_files(spark, known, read, folder)
    return sketches.read_sketches(spark, folder)


@query("corpus_summary_growing", _WORDS + """,
    sizes AS (
        SELECT coalesce(type, 'all') AS dataset, count(*) AS n_rows, sum(length(reviewText))::DOUBLE / count(*) AS l,
               avg(overall::DOUBLE) AS s
        FROM v_reviews GROUP BY GROUPING SETS ((type), ()))
    SELECT dataset, n_rows, TRUE AS words_close, TRUE AS chars_close, round(l, 6) AS mean_length, round(s, 6) AS mean_score
    FROM sizes JOIN unique_w USING (dataset) JOIN unique_c USING (dataset)""")
def corpus_summary_growing(spark, d):
    """Distinct counts are estimates; they are held against the exact ones and must lie within 2 % of them."""
    exact = profile.corpus_summary(views.review_corpus(spark, d)).select(
        "dataset", F.col("unique_words").alias("w"), F.col("unique_chars").alias("c"))

    def close(found, true):
        return F.abs(F.col(found) - F.col(true)) <= 0.02 * F.col(true)

    return sketches.growing_summary(_grown(spark, d)).join(exact, "dataset").select(
        "dataset", "n_rows", close("unique_words", "w").alias("words_close"), close("unique_chars", "c").alias("chars_close"),
        F.round("mean_length", 6).alias("mean_length"), F.round("mean_score", 6).alias("mean_score"))


@query("score_quantiles_growing", """
    SELECT coalesce(type, 'all') AS dataset, p AS prob, count(*) AS n_scores, TRUE AS inside
    FROM v_reviews, (VALUES (0.1::DOUBLE), (0.25), (0.5), (0.75), (0.9)) q(p)
    GROUP BY GROUPING SETS ((type, p), (p))""")
def score_quantiles_growing(spark, d):
    """Quantiles from sketches lie a stated rank error off at most: the rows below and up to each are counted."""
    rows = views.reviews(spark, d).select("type", F.col("overall").cast("double").alias("v"))
    found = via_table(sketches.growing_quantiles(_grown(spark, d), (0.1, 0.25, 0.5, 0.75, 0.9)), "quantiles")  # five rows a category
    counts = rows.groupBy("type", "v").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy("v").agg(F.sum("n").alias("n")).select(F.lit(profile.ALL).alias("dataset"), "v", "n")
    each = counts.select(F.col("type").alias("dataset"), "v", "n").unionByName(whole)
    ranked = found.join(each, "dataset").groupBy("dataset", "prob", "n_scores", "rank_error").agg(
        F.sum(F.when(F.col("v") < F.col("value"), F.col("n")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("v") <= F.col("value"), F.col("n")).otherwise(0)).alias("upto"))
    slack = F.col("rank_error") * F.col("n_scores") + 1
    rank = F.col("prob") * F.col("n_scores")
    return ranked.select("dataset", "prob", "n_scores", ((F.col("below") - slack <= rank) & (rank <= F.col("upto") + slack)).alias("inside"))


@query("unique_words", _WORDS + "SELECT dataset, unique_words FROM unique_w")
def unique_words(spark, d):
    return profile.unique_words(views.review_corpus(spark, d))


@query("unique_chars", _WORDS + "SELECT dataset, unique_chars FROM unique_c")
def unique_chars(spark, d):
    return profile.unique_chars(views.review_corpus(spark, d))


@query("score_counts_wide", """
    SELECT coalesce(type, 'all') AS dataset, count(*) FILTER (WHERE overall = 1) AS score_1,
           count(*) FILTER (WHERE overall = 2) AS score_2, count(*) FILTER (WHERE overall = 3) AS score_3,
           count(*) FILTER (WHERE overall = 4) AS score_4, count(*) FILTER (WHERE overall = 5) AS score_5
    FROM v_reviews GROUP BY GROUPING SETS ((type), ())""")
def score_counts_wide(spark, d):
    return profile.score_counts_wide(views.review_corpus(spark, d))


@query("score_range_by_group", """
    SELECT type, round(avg(overall::DOUBLE), 8) AS mean_score, min(overall) AS min_score, max(overall) AS max_score
    FROM v_reviews GROUP BY type""")
def score_range_by_group(spark, d):
    return profile.score_range_by_group(views.review_corpus(spark, d))


@query("distinct_scores", "SELECT DISTINCT overall FROM v_reviews")
def distinct_scores(spark, d):
    return profile.distinct_scores(views.review_corpus(spark, d))


@query("distinct_scores_by_group", """
    SELECT essay_set, count(*) AS n_scores, string_agg(s::VARCHAR, ',' ORDER BY s) AS scores
    FROM (SELECT DISTINCT essay_set, domain1_score AS s FROM v_essays_clean) GROUP BY essay_set""")
def distinct_scores_by_group(spark, d):
    found = profile.distinct_scores_by_group(views.essays_corpus(views.essays_clean(spark, d)))
    return found.select("essay_set", F.col("n_scores").cast("bigint").alias("n_scores"),
                        F.array_join(F.col("scores").cast("array<string>"), ",").alias("scores"))


_DISTRIBUTION = """
    SELECT type AS dataset, overall, count(*) AS n FROM {v} GROUP BY type, overall
    UNION ALL SELECT 'all', overall, count(*) FROM {v} GROUP BY overall"""


@query("score_distribution", _DISTRIBUTION.format(v="v_reviews"))
def score_distribution(spark, d):
    return profile.score_distribution(views.review_corpus(spark, d))


@query("score_distribution_binarized",
       "WITH b AS (SELECT * REPLACE (CASE WHEN overall > 4 THEN 1 ELSE 0 END AS overall) FROM v_reviews)"
       + _DISTRIBUTION.format(v="b"))
def score_distribution_binarized(spark, d):
    return profile.score_distribution_binarized(views.review_corpus(spark, d))


@query("histogram_by_group", """
    WITH limits AS (SELECT essay_set, min(domain1_score)::DOUBLE AS lo, max(domain1_score)::DOUBLE AS hi
                    FROM v_essays_clean GROUP BY essay_set),
    edges AS (SELECT essay_set, k, CASE WHEN k = 10 THEN hi ELSE lo + k * ((hi - lo) / 10) END AS edge
              FROM limits, range(11) r(k)),
    bins AS (SELECT a.essay_set, a.k AS bin, a.edge AS low, b.edge AS high
             FROM edges a JOIN edges b ON a.essay_set = b.essay_set AND b.k = a.k + 1)
    SELECT b.essay_set, bin::INT AS bin, round(low, 6) AS low, round(high, 6) AS high, count(*) AS n
    FROM bins b JOIN v_essays_clean e ON e.essay_set = b.essay_set
         AND e.domain1_score >= low AND (e.domain1_score < high OR (bin = 9 AND e.domain1_score <= high))
    GROUP BY ALL""")
def histogram_by_group(spark, d):
    return profile.histogram_by_group(views.essays_clean(spark, d), "domain1_score", "essay_set").select(
        "essay_set", "bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n"
    )


_DESCRIBE = """
    WITH long AS (
        SELECT essay_set, 'domain1_score' AS "column", domain1_score::DOUBLE AS v FROM v_essays_clean
        UNION ALL SELECT essay_set, 'domain2_score', domain2_score::DOUBLE FROM v_essays_clean),
    stats AS (
        SELECT essay_set, "column", CASE WHEN count(v) > 0 THEN count(v)::DOUBLE END AS "count", avg(v) AS mean,
               stddev_samp(v) AS std, min(v) AS min, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50,
               quantile_cont(v, 0.75) AS p75, max(v) AS max
        FROM long GROUP BY essay_set, "column")
"""


@query("describe_by_group", _DESCRIBE + """
    SELECT essay_set, "column", "count", round(mean, 6) AS mean, round(std, 6) AS std, min, p25, p50, p75, max FROM stats""")
def describe_by_group(spark, d):
    rows = profile.describe_by_group(views.essays_clean(spark, d), "essay_set", ["domain1_score", "domain2_score"])
    return rows.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


_SETS = ", ".join(f"max(CASE WHEN essay_set = {s} THEN v END) AS set_{s}" for s in range(1, 9))


@query("describe_report", _DESCRIBE + f"""
    , metrics AS (
        SELECT essay_set, "column", 'count' AS metric, "count" AS v FROM stats
        UNION ALL SELECT essay_set, "column", 'mean', round(mean, 2) FROM stats
        UNION ALL SELECT essay_set, "column", 'min', min FROM stats
        UNION ALL SELECT essay_set, "column", 'max', max FROM stats)
    SELECT "column", metric, {_SETS} FROM metrics GROUP BY "column", metric""")
def describe_report(spark, d):
    return profile.describe_report(views.essays_clean(spark, d), "essay_set", ["domain1_score", "domain2_score"])


def _essays(spark, d):
    return views.essays_raw(spark, d)


_ENTITY = f"""
    WITH words AS (SELECT unnest(regexp_split_to_array(essay, '{BLANK}+')) AS word FROM v_essays_raw),
    tagged AS (SELECT word FROM words WHERE starts_with(word, '@'))
"""


@query("entity_words", _ENTITY + "SELECT DISTINCT word FROM tagged")
def entity_words(spark, d):
    return profile.entity_words(_essays(spark, d), "essay")


@query("entity_tag_counts", _ENTITY + """
    SELECT tag, count(*) AS n FROM (SELECT regexp_extract(word, '@+[A-Z]+[0-9]*') AS tag FROM tagged)
    WHERE tag <> '' GROUP BY tag""")
def entity_tag_counts(spark, d):
    return profile.entity_tag_counts(_essays(spark, d), "essay")


@query("entity_tag_types", _ENTITY + """
    SELECT DISTINCT tag_type FROM (SELECT regexp_extract(word, '@+[A-Z]+') AS tag_type FROM tagged) WHERE tag_type <> ''""")
def entity_tag_types(spark, d):
    return profile.entity_tag_types(_essays(spark, d), "essay")


@query("token_length_stats", """
    SELECT min(len(words)) AS min_tokens, max(len(words)) AS max_tokens, round(avg(len(words)::DOUBLE), 6) AS mean_tokens,
           (SELECT len(words) FROM v_words ORDER BY length(text) DESC, len(words) DESC LIMIT 1) AS tokens_of_longest
    FROM v_words""")
def token_length_stats(spark, d):
    words = word_lists(views.documents(spark, d), "text")
    return profile.token_length_stats(words, "words", "text").withColumn("mean_tokens", F.round("mean_tokens", 6))
