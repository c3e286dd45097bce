"""Readers for review and essay files, vocabularies and category lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textscore.operators.clean import (
    clean_essays, coerce_numeric, drop_incomplete, null_tokens, preprocess_essays, union_sources,
)
from textscore.operators.selection import RowOrder, keep_first, positions
from textscore.session import parallelism
from textscore.sources.arrays import read_json_arrays
from textscore.sources.quoted import read_quoted
from textscore.sources.schemas import ALL_REVIEW_SCHEMA, ESSAY_SCHEMA

# The review categories and the ones used if none are named.
REVIEW_CATEGORIES = (
    "amazon_fashion", "all_beauty", "appliances", "arts_crafts_and_sewing", "automotive", "books",
    "cds_and_vinyl", "cellphones_and_accessories", "clothing_shoes_and_jewelry", "digital_music",
    "electronics", "gift_cards", "grocery_and_gourmet_food", "home_and_kitchen",
    "industrial_and_scientific", "kindle_store", "luxury_beauty", "magazine_subscriptions",
    "movies_and_tv", "musical_instruments", "office_products", "patio_lawn_and_garden",
    "pet_supplies", "prime_pantry", "software", "sports_and_outdoors",
    "tools_and_home_improvement", "toys_and_games", "video_games",
)
DEFAULT_CATEGORIES = (
    "digital_music", "luxury_beauty", "musical_instruments", "office_products",
    "patio_lawn_and_garden", "prime_pantry", "software", "video_games",
)


def _category(pattern: str, file: str = "_metadata.file_path") -> Column:
    path = F.url_decode(F.replace(F.col(file), F.lit("+"), F.lit("%2B")))
    return F.regexp_extract(path, pattern, 1)


def _placed(rows: DataFrame) -> DataFrame:
    """Add the place of every row: its file, the block of the file and its number among the rows of a task."""
    number = F.monotonically_increasing_id().bitwiseAND(2**33 - 1)
    return rows.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_line": number})


def _file_order() -> RowOrder:
    return RowOrder(F.struct("_file", "_block", "_line"), F.struct("_file", "_block"))


def _indexed(placed: DataFrame, index: str | None) -> DataFrame:
    """Number the rows in the order of files and lines, block by block, and drop their places."""
    if index:
        placed = positions(placed, _file_order(), name=index)
    return placed.drop("_file", "_block", "_line")


def _read_reviews(spark, paths, schema: T.StructType, pattern: str, index: str | None, arrays: bool = False) -> DataFrame:
    if arrays:
        rows = read_json_arrays(spark, paths, schema).withColumn("type", _category(pattern, "_file"))
    else:
        rows = _placed(spark.read.schema(schema).json(list(paths))).withColumn("type", _category(pattern))
    rows = rows.where(F.col("type") != "")
    return _indexed(drop_incomplete(rows, ["reviewText", "overall"]), index)


def load_reviews(
    spark: SparkSession, paths: Sequence[str], schema: T.StructType = ALL_REVIEW_SCHEMA, arrays: bool = True,
    index: str | None = None,
) -> DataFrame:
    """Reviews from ``<category>.json`` files or folders of such name.

    ``arrays`` reads a file as one JSON array, by as many tasks as its size asks for; ``arrays=False`` takes newline JSON, in
    a single pass. Files whose
    second name part is not ``json`` are left out, as are rows without text or
    score. ``index`` names a column that numbers the rows from 0 in the order of files and lines;
    ``schema`` names the fields to keep: all of them by default, text and score with ``REVIEW_SCHEMA``. Fields that are
    not used later are not parsed in either case.
    """
    return _read_reviews(
        spark, paths, schema, r"/(?:[^/=]+=)?([^/.=]+)\.json(?:\.gz)?(?:/|$)", index, arrays
    )


def load_reviews_jsonl(
    spark: SparkSession, paths: Sequence[str], nrows_per_type: int | None = None,
    schema: T.StructType = ALL_REVIEW_SCHEMA, index: str | None = None,
) -> DataFrame:
    """Reviews from newline JSON; the category is the name part before ``-``.

    With ``nrows_per_type`` the first lines of each file are kept. The place of
    a line is the block of the file it lies in and its number inside that block,
    so a file of any size is cut without passing through one task.
    """
    pattern = r"/(?:[^/=]+=)?([^/=-]+)-[^/]*\.json[^/]*(?:/|$)"
    if nrows_per_type is None:
        return _read_reviews(spark, paths, schema, pattern, index)
    lines = (
        _placed(spark.read.text(list(paths))).withColumn("type", _category(pattern))
        .where((F.col("type") != "") & (F.trim("value") != ""))
    )
    order = RowOrder(F.struct("_block", "_line"), F.col("_block"))
    kept = keep_first(lines, ["_file"], order, nrows_per_type)
    rows = kept.withColumn("row", F.from_json("value", schema)).select("row.*", "type", "_file", "_block", "_line")
    return _indexed(drop_incomplete(rows, ["reviewText", "overall"]), index)


def read_gzip_jsonl(
    spark: SparkSession, path: str, limit: int | None = None, schema: T.StructType = ALL_REVIEW_SCHEMA
) -> DataFrame:
    """Newline JSON in gzip, at most ``limit`` leading lines in the order of files.

    A gzip file is read by one task; the rows are then spread out. Lines are cut where they are
    read, and no task gathers them.
    """
    if limit is None:
        return spark.read.schema(schema).json(path).repartition(parallelism(spark))
    lines = keep_first(_placed(spark.read.text(path)).where(F.trim("value") != ""), [], _file_order(), limit)
    return lines.select(F.from_json("value", schema).alias("row")).select("row.*").repartition(parallelism(spark))


def load_essays(
    spark: SparkSession, train: str | None = None, valid: str | None = None, test: str | None = None,
    schema: T.StructType = ESSAY_SCHEMA, index: str | None = None,
) -> DataFrame:
    """Essay tables from TSV with a header, marked by column ``split``; a file is read by as many tasks as its size asks for.

    The training part is cleaned and its score is binned; the others are kept as
    they are, as numbers where they are numbers. ``index`` names a column that numbers the rows of
    each part from 0, after cleaning.
    """
    def numbered(path: str, clean) -> DataFrame:
        rows, places = read_quoted(spark, path, schema), ["_file", "_block", "_line"]
        return _indexed(clean(rows, places), index) if index else clean(rows.drop(*places))

    parts = []
    if train:
        parts.append(numbered(train, preprocess_essays).withColumn("split", F.lit("train")))
    for path, name in ((valid, "valid"), (test, "test")):
        if path:
            part = numbered(path, lambda rows, keep=(): coerce_numeric(null_tokens(rows), ("essay", *keep)))
            parts.append(part.withColumn("split", F.lit(name)))
    if not parts:
        raise ValueError("name at least one of train, valid, test")
    return union_sources(*parts)


def load_essays_json(
    spark: SparkSession, paths: dict[str, str], schema: T.StructType = ESSAY_SCHEMA, arrays: bool = True
) -> DataFrame:
    """Essay tables from JSON, each cleaned, keyed by the name of its split.

    Scores stay as they are; binning or scaling is chosen afterwards.
    """
    def read(path: str) -> DataFrame:
        return read_json_arrays(spark, [path], schema).drop("_file", "_block", "_line") if arrays else spark.read.schema(schema).json(path)

    return union_sources(*[
        clean_essays(read(path)).withColumn("split", F.lit(name)) for name, path in paths.items()
    ])


def read_category_list(spark: SparkSession, path: str) -> list[str]:
    """Category names from the first line of a comma-separated file."""
    line = spark.read.text(path).first()
    return [name.strip() for name in line[0].split(",")] if line else []


def category_allowlist(
    df: DataFrame, allowed: Sequence[str] | str = DEFAULT_CATEGORIES, col: str = "type",
    known: Sequence[str] = REVIEW_CATEGORIES,
) -> DataFrame:
    """Rows of the allowed categories. ``"all"`` allows every known one.

    A name that is not known raises. The list is a filter, so it reaches the
    scan and prunes partitions.
    """
    names = list(known) if allowed == "all" else list(allowed)
    unknown = sorted(set(names) - set(known))
    if unknown:
        raise KeyError(f"unknown categories: {', '.join(unknown)}")
    return df.where(F.col(col).isin(*names))


def vocab_load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vocabulary and merges written by ``vocab_save``, or a tokenizer JSON file."""
    if path.endswith(".json"):
        return _vocab_from_json(spark, path)
    return spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/merges")


def _vocab_from_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Merges may be ``"left right"`` strings or ``[left, right]`` pairs."""
    pair_form = T.StructType.fromDDL("model struct<vocab: map<string,int>, merges: array<array<string>>>")
    text_form = T.StructType.fromDDL("model struct<vocab: map<string,int>, merges: array<string>>")

    def read(schema: T.StructType) -> DataFrame:
        return spark.read.schema(schema).option("multiLine", True).json(path)

    vocab = read(text_form).select(F.explode("model.vocab").alias("token", "id"))
    as_text = read(text_form).select(F.posexplode("model.merges").alias("rank", "rule"))
    if as_text.where(F.col("rule").startswith("[")).limit(1).count():
        merges = read(pair_form).select(F.posexplode("model.merges").alias("rank", "rule")).select(
            "rank", F.get("rule", F.lit(0)).alias("left"), F.get("rule", F.lit(1)).alias("right")
        )
    else:
        merges = as_text.select(
            "rank", F.split_part("rule", F.lit(" "), F.lit(1)).alias("left"),
            F.split_part("rule", F.lit(" "), F.lit(2)).alias("right"),
        )
    return vocab, merges
