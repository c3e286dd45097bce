"""Queries over cleaning and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from textscore.operators import clean, labels
from textscore.operators.profile import bin_distribution
from textscore.plans import views
from textscore.plans.registry import query
from textscore.plans.views_sql import TAGS, binned, null_token, number, quartile_class


@query("null_tokens", f"""
    SELECT essay_id, essay_set, essay, {null_token('domain1_score')} AS domain1_score,
           {null_token('domain2_score')} AS domain2_score FROM v_essays_raw""")
def null_tokens(spark, d):
    return clean.null_tokens(views.essays_raw(spark, d))


@query("coerce_numeric", f"""
    SELECT {number('essay_id')} AS essay_id, {number('essay_set')} AS essay_set, essay,
           {number('domain1_score')} AS domain1_score, {number('domain2_score')} AS domain2_score FROM v_essays_raw""")
def coerce_numeric(spark, d):
    return clean.coerce_numeric(views.essays_raw(spark, d))


@query("count_nonintegral", """
    SELECT count(*) FILTER (WHERE l_extendedprice <> floor(l_extendedprice)) AS l_extendedprice,
           count(*) FILTER (WHERE l_quantity <> floor(l_quantity)) AS l_quantity FROM lineitem""")
def count_nonintegral(spark, d):
    return clean.count_nonintegral(views.table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"])


@query("drop_incomplete", f"""
    SELECT essay_id, essay_set, domain1_score FROM v_essays_raw
    WHERE {null_token('essay')} IS NOT NULL AND {null_token('domain1_score')} IS NOT NULL""")
def drop_incomplete(spark, d):
    rows = clean.null_tokens(views.essays_raw(spark, d))
    return clean.drop_incomplete(rows, ["essay", "domain1_score"]).select("essay_id", "essay_set", "domain1_score")


@query("row_id", """
    SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents""")
def row_id(spark, d):
    return clean.row_id(views.documents(spark, d).select("doc_id", "source"), "doc_id")


@query("split_entity_tags", f"""
    SELECT essay_id, regexp_replace(essay, '({TAGS})', '\\1 ', 'g') AS essay
    FROM v_essays_raw""")
def split_entity_tags(spark, d):
    return clean.split_entity_tags(views.essays_raw(spark, d).select("essay_id", "essay"), "essay")


@query("preprocess_essays", "SELECT * FROM v_essays")
def preprocess_essays(spark, d):
    return views.essays(spark, d)


@query("union_sources", """
    SELECT row_id AS id, reviewText AS body, type, NULL::BIGINT AS essay_set FROM v_reviews
    UNION ALL SELECT essay_id, essay, NULL, essay_set FROM v_essays_clean""")
def union_sources(spark, d):
    return clean.union_sources(
        views.reviews(spark, d).select(F.col("row_id").alias("id"), F.col("reviewText").alias("body"), "type"),
        views.essays_clean(spark, d).select(F.col("essay_id").alias("id"), F.col("essay").alias("body"), "essay_set"),
    )


@query("replace_column_keep_rest", """
    SELECT essay_id, essay_set, (domain1_score * 10)::BIGINT AS domain1_score FROM v_essays_clean""")
def replace_column(spark, d):
    rows = views.essays_clean(spark, d).select("essay_id", "domain1_score", "essay_set")
    return clean.replace_column_keep_rest(rows, "domain1_score", F.col("domain1_score") * 10)


@query("string_guard", """
    SELECT source, count(*) AS n_rows, count(t) AS n_texts, coalesce(sum(length(t)), 0)::BIGINT AS n_chars
    FROM (SELECT d.source, CASE WHEN l.quality = 1 THEN d.text END AS t
          FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY source""")
def string_guard(spark, d):
    rows = views.documents(spark, d).join(views.table(spark, d, "labels"), "doc_id", "left")
    rows = rows.withColumn("t", F.when(F.col("quality") == 1, F.col("text")))
    return clean.string_guard(rows, "t", "source")


@query("unique_labels", "SELECT DISTINCT overall FROM v_reviews")
def unique_labels(spark, d):
    return clean.unique_labels(views.review_corpus(spark, d))


@query("unique_categories", "SELECT 'All' AS type UNION ALL SELECT DISTINCT type FROM v_reviews")
def unique_categories(spark, d):
    return clean.unique_categories(views.review_corpus(spark, d), with_all=True)


@query("num_classes", "SELECT count(DISTINCT overall) AS num_classes FROM v_reviews")
def num_classes(spark, d):
    return clean.num_classes(views.review_corpus(spark, d))


@query("head_rows", "SELECT row_id, reviewText, type, overall FROM v_reviews ORDER BY row_id LIMIT 5")
def head_rows(spark, d):
    return clean.head_rows(views.reviews(spark, d), "row_id")


# ---------------------------------------------------------------- labels

FIRST_EDGES = labels.ESSAY_PLAN[1][1]


def _scores(spark, d):
    return views.essays_clean(spark, d).select("essay_id", "essay_set", "domain1_score")


@query("bin_fixed_edges", f"""
    SELECT essay_id, essay_set, domain1_score, {binned('domain1_score', FIRST_EDGES)} AS label FROM v_essays_clean""")
def bin_fixed_edges(spark, d):
    return labels.bin_fixed_edges(_scores(spark, d), "domain1_score", FIRST_EDGES)


@query("shift_label", "SELECT essay_id, essay_set, domain1_score, domain1_score + 1 AS label FROM v_essays_clean")
def shift_label(spark, d):
    return labels.shift_label(_scores(spark, d), "domain1_score")


@query("bin_quantiles", f"""
    SELECT essay_id, essay_set, domain1_score, {quartile_class('domain1_score', 'e')} AS label
    FROM v_essays_clean JOIN v_edges USING (essay_set)""")
def bin_quantiles(spark, d):
    rows = _scores(spark, d).where(F.col("essay_set").isin(7, 8))
    return labels.bin_quantiles(rows, "domain1_score", 4, "essay_set")


@query("categorize_by_set", "SELECT essay_id, essay_set, domain1_score FROM v_essays")
def categorize_by_set(spark, d):
    return labels.categorize_by_set(_scores(spark, d))


@query("binarize_label", "SELECT row_id, type, CASE WHEN overall > 4 THEN 1 ELSE 0 END AS overall FROM v_reviews")
def binarize_label(spark, d):
    return labels.binarize_label(views.reviews(spark, d).select("row_id", "type", "overall"), "overall")


_STD = """
    WITH limits AS (
        SELECT essay_set, min(domain1_score) AS lo, max(domain1_score) AS hi FROM v_essays_clean GROUP BY essay_set),
    scaled AS (
        SELECT essay_id, essay_set, 2.0::DOUBLE * ((domain1_score - lo)::DOUBLE / nullif(hi - lo, 0)::DOUBLE) - 1.0 AS s
        FROM v_essays_clean JOIN limits USING (essay_set))
"""


@query("standardize_by_group", _STD + "SELECT essay_id, essay_set, round(s, 6) AS score_std FROM scaled")
def standardize_by_group(spark, d):
    rows = labels.standardize_by_group(_scores(spark, d), "domain1_score", "essay_set")
    return rows.select("essay_id", "essay_set", F.round("score_std", 6).alias("score_std"))


@query("standardize_binarize", _STD + "SELECT essay_id, essay_set, CASE WHEN s > 0 THEN 1 ELSE 0 END AS label FROM scaled")
def standardize_binarize(spark, d):
    rows = labels.standardize_binarize(_scores(spark, d), "domain1_score", "essay_set")
    return rows.select("essay_id", "essay_set", "label")


@query("label_reviews", """
    SELECT row_id, overall, CASE WHEN overall > 4 THEN 1 ELSE 0 END AS binary FROM v_reviews""")
def label_reviews(spark, d):
    rows = labels.label_reviews(views.reviews(spark, d).select("row_id", "overall"))
    return rows.join(labels.label_reviews(rows, score_type="binary").withColumnRenamed("overall", "binary"), "row_id")


@query("label_essays", _STD + """
    SELECT essay_id, e.domain1_score AS categorical, round(s, 6) AS standardized, CASE WHEN s > 0 THEN 1 ELSE 0 END AS "binary"
    FROM scaled JOIN v_essays e USING (essay_id)""")
def label_essays(spark, d):
    rows = _scores(spark, d)
    forms = [labels.label_essays(rows, score_type=t).select("essay_id", F.col("domain1_score").alias(t)) for t in ("categorical", "standardized", "binary")]
    return forms[0].join(forms[1], "essay_id").join(forms[2], "essay_id").withColumn("standardized", F.round("standardized", 6))


@query("class_index", "SELECT row_id, overall, overall - 1 AS y FROM v_reviews")
def class_index(spark, d):
    return labels.class_index(views.reviews(spark, d).select("row_id", "overall"), "overall")


@query("class_weights", """
    SELECT overall, count(*) AS n, round(sum(count(*)) OVER ()::DOUBLE / count(*), 6) AS weight
    FROM v_reviews GROUP BY overall""")
def class_weights(spark, d):
    return labels.class_weights(views.reviews(spark, d), "overall").select(
        "overall", "n", F.round("weight", 6).alias("weight")
    )


@query("bin_distribution", """
    SELECT essay_set, domain1_score, count(*) AS n FROM v_essays WHERE domain1_score IS NOT NULL
    GROUP BY essay_set, domain1_score""")
def bins(spark, d):
    return bin_distribution(views.essays(spark, d))
