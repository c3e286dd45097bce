"""Writers for texts, metrics and vocabularies. All write folders in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_text_export(df: DataFrame, x: str, out_dir: str) -> None:
    """All texts as plain lines; a line break inside a text becomes a blank."""
    lines = df.where(F.col(x).isNotNull()).select(F.regexp_replace(x, r"[\r\n]+", " ").alias("value"))
    lines.write.mode("overwrite").text(out_dir)


def write_metrics(df: DataFrame, out_dir: str) -> None:
    """Metrics as JSON, replacing earlier ones."""
    df.write.mode("overwrite").json(out_dir)


def append_metric_log(df: DataFrame, out_dir: str) -> None:
    """Add ``(run, tag, value, step)`` rows to a metric log."""
    df.select("run", "tag", F.col("value").cast("double").alias("value"), F.col("step").cast("bigint").alias("step")) \
        .write.mode("append").partitionBy("run").parquet(out_dir)


def vocab_save(vocab: DataFrame, merges: DataFrame, out_dir: str) -> None:
    vocab.write.mode("overwrite").parquet(f"{out_dir}/vocab")
    merges.write.mode("overwrite").parquet(f"{out_dir}/merges")
