"""Queries over filters, samples, balancing and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from textscore.operators import sampling
from textscore.operators.clean import union_sources
from textscore.plans import views
from textscore.plans.registry import query
from textscore.plans.views_sql import h, key

KEYS = ("row_id", "type", "overall")


def _keys(df):
    return df.select(*KEYS)


def _rows(spark, d):
    return _keys(views.reviews(spark, d))


_SELECT = "SELECT row_id, type, overall FROM v_reviews"


@query("filter_category", f"{_SELECT} WHERE type = 'src7'")
def filter_category(spark, d):
    return _keys(sampling.filter_category(views.review_corpus(spark, d), "src7"))


@query("filter_max_length", f"{_SELECT} WHERE length(reviewText) <= 1000")
def filter_max_length(spark, d):
    return _keys(sampling.filter_max_length(views.review_corpus(spark, d), 1000))


@query("filter_length_range", f"{_SELECT} WHERE length(reviewText) BETWEEN 1000 AND 6000")
def filter_length_range(spark, d):
    return _keys(sampling.filter_length_range(views.review_corpus(spark, d), *sampling.LENGTH_PRESETS["long"]))


@query("filter_score_eq", f"{_SELECT} WHERE overall = 3")
def filter_score_eq(spark, d):
    return _keys(sampling.filter_score_eq(views.review_corpus(spark, d), 3))


@query("filter_score_range", f"{_SELECT} WHERE overall BETWEEN 2 AND 4")
def filter_score_range(spark, d):
    return _keys(sampling.filter_score_range(views.review_corpus(spark, d), 2, 4))


@query("filter_columns", f"{_SELECT} WHERE type IN ('src2', 'src5') AND overall = 5")
def filter_columns(spark, d):
    return sampling.filter_columns(_rows(spark, d), {"type": ["src2", "src5"], "overall": 5})


@query("filter_load", f"""
    SELECT row_id, reviewText, overall FROM v_reviews
    WHERE length(reviewText) BETWEEN 10 AND 6000 AND overall BETWEEN 1 AND 5
    ORDER BY {key('row_id', 7)}, row_id LIMIT 25""")
def filter_load(spark, d):
    return sampling.filter_load(views.review_corpus(spark, d), length=[10, 6000], score=[1, 5], n=25, seed=7)


@query("sample_n", f"{_SELECT} ORDER BY {key('row_id', 42)}, row_id LIMIT 100")
def sample_n(spark, d):
    return sampling.sample_n(_rows(spark, d), 100, "row_id", 42)


@query("sample_per_group", f"""
    {_SELECT} WHERE type NOT IN ('src3')
    QUALIFY row_number() OVER (PARTITION BY type ORDER BY {key('row_id', 42)}, row_id) <= 2""")
def sample_per_group(spark, d):
    return sampling.sample_per_group(_rows(spark, d), "type", 2, "row_id", 42, exclude=["src3"])


@query("undersample", f"""
    WITH sizes AS (SELECT overall, count(*) AS n FROM v_reviews GROUP BY overall)
    {_SELECT}
    QUALIFY row_number() OVER (PARTITION BY overall ORDER BY {key('row_id', 42)}, row_id) <= (SELECT min(n) FROM sizes)""")
def undersample(spark, d):
    return sampling.undersample(_rows(spark, d), "overall", "row_id", 42)


@query("oversample", f"""
    WITH sizes AS (SELECT overall, count(*) AS n FROM v_reviews GROUP BY overall),
    ranked AS (
        SELECT row_id, type, overall, row_number() OVER (PARTITION BY overall ORDER BY {key('row_id', 42)}, row_id) - 1 AS p
        FROM v_reviews),
    draws AS (
        SELECT overall, draw, ({h("overall || '-' || draw", 42)}) % n AS p
        FROM sizes, range((SELECT max(n) FROM sizes)) r(draw))
    SELECT r.row_id, r.type, r.overall, draw FROM draws JOIN ranked r USING (overall, p)""")
def oversample(spark, d):
    return sampling.oversample(_rows(spark, d), "overall", "row_id", 42)


_RANKED = f"""
    WITH ranked AS (
        SELECT row_id, type, overall, row_number() OVER (ORDER BY {key('row_id', 42)}, row_id) - 1 AS p,
               count(*) OVER () AS n FROM v_reviews)
"""


@query("random_split", _RANKED + """
    SELECT row_id, type, overall,
           CASE WHEN p < n - floor(n * 0.2::DOUBLE) THEN 0 ELSE 1 END AS part FROM ranked""")
def random_split(spark, d):
    return sampling.split_exact(_rows(spark, d), [0.8, 0.2], "row_id", 42)


@query("split_exact_three", _RANKED + """
    , sized AS (
        SELECT *, floor(n * 0.5::DOUBLE) AS a, floor(n * 0.3::DOUBLE) AS b, floor(n * 0.2::DOUBLE) AS c FROM ranked),
    ends AS (
        SELECT *, a + CASE WHEN n - a - b - c > 0 THEN 1 ELSE 0 END AS e1,
               b + CASE WHEN n - a - b - c > 1 THEN 1 ELSE 0 END AS s2 FROM sized)
    SELECT row_id, type, overall, CASE WHEN p < e1 THEN 0 WHEN p < e1 + s2 THEN 1 ELSE 2 END AS part FROM ends""")
def split_three(spark, d):
    return sampling.split_exact(_rows(spark, d), [0.5, 0.3, 0.2], "row_id", 42)


@query("split_hash", f"""
    SELECT row_id, type, overall,
           CASE WHEN {h('row_id', 42)} >= {int(0.8 * 2**32)} THEN 1 ELSE 0 END AS part FROM v_reviews""")
def split_hash(spark, d):
    return sampling.split_hash(_rows(spark, d), [0.8, 0.2], "row_id", 42)


@query("balanced_train_input", _RANKED + f"""
    , parts AS (SELECT *, p >= n - floor(n * 0.2::DOUBLE) AS valid FROM ranked),
    sizes AS (SELECT overall, count(*) AS n FROM parts WHERE NOT valid GROUP BY overall)
    SELECT row_id, type, overall, 'valid' AS part FROM parts WHERE valid
    UNION ALL
    SELECT row_id, type, overall, 'train' FROM (
        SELECT * FROM parts WHERE NOT valid
        QUALIFY row_number() OVER (PARTITION BY overall ORDER BY {key('row_id', 42)}, row_id) <= (SELECT min(n) FROM sizes))""")
def balanced_train_input(spark, d):
    train, valid = sampling.balanced_train_input(_rows(spark, d), "overall", "row_id", 0.2, 42, under=True)
    return union_sources(train.withColumn("part", F.lit("train")), valid.withColumn("part", F.lit("valid")))
