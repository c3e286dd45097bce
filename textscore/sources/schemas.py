"""Declared schemas; nothing is inferred from large input."""

from pyspark.sql import types as T

REVIEW_SCHEMA = T.StructType([
    T.StructField("reviewText", T.StringType()),
    T.StructField("overall", T.DoubleType()),
])

# The fields of a review file.
ALL_REVIEW_SCHEMA = T.StructType([
    *REVIEW_SCHEMA.fields,
    T.StructField("verified", T.BooleanType()),
    T.StructField("reviewTime", T.StringType()),
    T.StructField("reviewerID", T.StringType()),
    T.StructField("asin", T.StringType()),
    T.StructField("style", T.MapType(T.StringType(), T.StringType())),
    T.StructField("reviewerName", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("unixReviewTime", T.LongType()),
    T.StructField("vote", T.StringType()),
    T.StructField("image", T.ArrayType(T.StringType())),
])

ESSAY_SCHEMA = T.StructType([
    T.StructField("essay_id", T.StringType()),
    T.StructField("essay_set", T.StringType()),
    T.StructField("essay", T.StringType()),
    T.StructField("domain1_score", T.StringType()),
    T.StructField("domain2_score", T.StringType()),
])
