"""Quality rules whose cutoffs are chosen under a bound on false rejections; DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textscore.llm.common import written, whole_text

BLANKS = "[\\x20\\x09-\\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: A rule rejects a text whose statistic lies above the cutoff. Candidates are fixed beforehand, as the bounds need: level 1
#: takes the last cutoff of every rule, which rejects least, level 2 the one before, and so on.
RULES = {
    "symbols_per_word": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 2.0),
    "exclaims_per_word": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 2.0),
    "repeat_share": (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.45),
    "dup_line_share": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8),
    "adjacent_share": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5),
    "upper_share": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8),
}
LEVELS = len(RULES["repeat_share"])


@dataclass(frozen=True)
class Risk:
    """False rejections of good texts: at most ``share`` by all rules together in each stratum, for all strata at confidence ``1 - delta``.

    Among levels that keep to this, a good text lost weighs as much as ``cost`` bad ones caught.
    """

    share: float = 0.05
    delta: float = 0.05
    cost: int = 10


def statistics(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """Counts of every text by built-in functions, with the columns ``keep``; no shuffle.

    A text without a repeated 3-word window, which most are, is told by a set of window hashes; only the others have
    their windows sorted.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"kept_{c}") for c in keep], whole_text(text_col).alias("text"))
    kept = ["id", *[f"kept_{c}" for c in keep]]
    rows = rows.select(
        *kept, F.filter(F.split(text, BLANKS), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
        F.length(F.translate(text, BLANK_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long").alias("n_exclaims"),
        F.octet_length(F.regexp_replace(text, "[^\\p{Lu}]+", "")).cast("long").alias("upper_bytes"), F.xxhash64(text).alias("text_hash"),
    )
    words = F.col("words")
    window = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    rows = rows.select(
        *kept, "text_hash", "word_chars", "n_symbols", "n_exclaims", "upper_bytes", F.size(words).cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))).cast("long").alias("n_adjacent"),
        F.when(F.size(words) > 3, F.slice(window, 1, F.greatest(F.size(words) - 2, F.lit(0)))).alias("windows"),
    )
    windows = F.col("windows")
    rows = rows.withColumn("placed", F.when(
        F.size(F.array_distinct(windows)) < F.size(windows),
        F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("windows")
    placed = F.col("placed")
    again = F.filter(placed, lambda e, k: (e.h == F.get(placed, k - 1).h) | (e.h == F.get(placed, k + 1).h))
    covered = F.flatten(F.transform(again, lambda e: F.array(e.i, e.i + 1, e.i + 2)))
    return rows.withColumn("n_repeat_words", F.coalesce(F.size(F.array_distinct(covered)), F.lit(0)).cast("long")).drop("placed")


def with_rules(rows: DataFrame) -> DataFrame:
    """The statistic of every rule; a text without words or lines has zeros."""
    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return rows.withColumns({
        "symbols_per_word": share("n_symbols", "n_words"), "exclaims_per_word": share("n_exclaims", "n_words"),
        "repeat_share": share("n_repeat_words", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "adjacent_share": share("n_adjacent", "n_words"), "upper_share": share("upper_bytes", "word_chars"),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    })


def log_binomial_tail(rejected: Column, trials: Column, share: float) -> Column:
    """Log of P(X <= rejected) for X ~ Binomial(trials, share), exact, summed in logs so that it cannot underflow."""
    odds = F.log(F.lit(share / (1 - share)))
    first = trials * F.log(F.lit(1 - share))
    start = F.struct(first.cast("double").alias("term"), first.cast("double").alias("total"))

    def add(state: Column, i: Column) -> Column:
        term = state.term + F.log((trials - i + 1) / i) + odds
        high, low = F.greatest(state.total, term), F.least(state.total, term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    steps = F.when(rejected > 0, F.sequence(F.lit(1).cast("long"), rejected)).otherwise(F.array().cast("array<bigint>"))
    return F.when(rejected >= trials, F.lit(0.0)).otherwise(F.aggregate(steps, start, add, lambda s: s.total))


def over_level(level: int) -> Column:
    """Whether any rule rejects at a level."""
    return F.greatest(*[(F.col(rule) > values[-level]).cast("int") for rule, values in RULES.items()]) == 1


def levels(labelled: DataFrame, stratum: str, label: str, risk: Risk = Risk()) -> DataFrame:
    """The chosen level of each stratum that has one: ``stratum, level`` and the counts behind it.

    ``labelled`` has the statistics and labels of the holdout, one row per text. For each stratum the hypotheses "the rules of this level
    together reject more than ``risk.share`` of good texts" are tested from the loosest level on by their exact binomial tails, until
    the first that cannot be rejected. In this fixed order each test may use the whole level of its stratum, ``risk.delta`` divided by the
    number of strata (Bonferroni), so all certified levels hold together with confidence ``1 - risk.delta``. Of the
    certified ones the one with the most bad texts rejected, less ``risk.cost`` for each good one, is taken, the loosest of equals.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), over_level(n).alias("over")) for n in range(1, LEVELS + 1)])).alias("test")
    good, over = F.col(label) == 1, F.col("test.over")
    counted = labelled.select(stratum, label, each).groupBy(F.col(stratum), F.col("test.level").alias("level")).agg(
        F.sum(good.cast("long")).alias("good"), F.sum((good & over).cast("long")).alias("good_over"),
        F.sum((~good & over).cast("long")).alias("bad_over"))
    strata = labelled.agg(F.count_distinct(F.coalesce(F.col(stratum).cast("string"), F.lit("")))).first()[0]
    passed = log_binomial_tail(F.col("good_over"), F.col("good"), risk.share) <= math.log(risk.delta / max(1, strata))
    looser = Window.partitionBy(stratum).orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    certified = counted.withColumn("passed", F.min(passed.cast("int")).over(looser)).where("passed = 1")  # a row a level
    best = F.max_by(F.struct("level", "good", "good_over", "bad_over"), F.struct(F.col("bad_over") - risk.cost * F.col("good_over"), -F.col("level")))
    return certified.groupBy(stratum).agg(best.alias("best")).select(stratum, "best.*")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  stratum_col: str = "lang", label_col: str = "quality", risk: Risk = Risk()) -> DataFrame:
    """Counts, the fixed base rules and the risk-controlled verdict of every text.

    Returns ``id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long), ``base_failed``, ``kept``
    and ``failed_rules`` (comma-joined names of the certified rules that reject). Null and empty texts have zeros and fail the base rules.
    The stratum null is a stratum of its own. Ids without a label, labels without a text and labels other than 0 and 1 teach nothing.
    Copies of a text in a stratum are one trial, as trials must not depend on each other, and a good one if any label says so. Other columns of ``docs`` are left out. No rows give no rows; without labels only base rules reject.
    """
    counted = written(statistics(docs, id_col, text_col, [stratum_col]), "statistics")
    rows = with_rules(counted.withColumnRenamed(f"kept_{stratum_col}", "stratum"))
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    holdout = rows.where(~F.col("base_failed")).join(known, "id").groupBy("stratum", "text_hash").agg(
        F.max("label").alias("label"), *[F.first(r).alias(r) for r in RULES])
    chosen = levels(holdout, "stratum", "label", risk).select(F.col("stratum").alias("of"), "level")
    failed = F.array_compact(F.array(*[
        F.when(F.col(r) > F.get(F.array(*map(F.lit, reversed(values))), F.col("level") - 1), F.lit(r)) for r, values in RULES.items()]))
    judged = rows.join(chosen, rows["stratum"].eqNullSafe(chosen["of"]), "left").withColumn("failed", failed)
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), F.array_join("failed", ",").alias("failed_rules"))
