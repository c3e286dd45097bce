"""Benchmark decontamination by a positional inverted index of the corpus; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textscore.llm.common import dropped, whole_text, written

#: What stands between words, before letters A-Z are lower-cased.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
WINDOW_WORDS = 10
BROADCAST_ROWS = 500_000


def at_most(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it was counted and is small; else the join shuffles, and adaptive execution splits hot keys."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def words_of(text: Column) -> Column:
    """Words of a text in order, letters still as they are."""
    return F.array_remove(F.split(text, SEPARATORS), "")


def lowered(word: Column) -> Column:
    """A-Z in lower case and nothing else; words of ASCII only take the fast way."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(
        F.translate(word, ascii_uppercase, ascii_lowercase))


@dataclass(frozen=True)
class Windows:
    """What is searched for: ``items(window, item)``, ``slots(window, length, offset, term)`` and ``terms(term, word)``."""

    items: DataFrame
    slots: DataFrame
    terms: DataFrame

    def drop(self) -> None:
        for df in (self.items, self.slots, self.terms):
            dropped(df)


def item_windows(items: DataFrame, id_col: str, text_col: str, size: int = WINDOW_WORDS) -> Windows:
    """Every run of ``size`` words of an item; an item of fewer words, but not none, is one window."""
    words = F.transform(words_of(whole_text(text_col)), lowered)
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words.alias("words")).where(F.size("words") > 0)
    length = F.least(F.lit(size), F.size("words"))
    runs = F.transform(F.sequence(F.lit(0), F.size("words") - length), lambda i: F.slice("words", i + 1, length))
    found = rows.select("item", F.explode(runs).alias("words")).distinct()
    named = written(found.select("words").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    of_items = written(found.join(named, "words").select("window", "item"), "window-items")
    placed = named.select("window", F.size("words").alias("length"), F.posexplode("words").alias("offset", "word"))
    terms = written(placed.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "terms")
    slots = written(placed.join(terms, "word").select("window", "length", "offset", "term"), "slots")
    dropped(named)
    return Windows(of_items, slots, terms)


@dataclass(frozen=True)
class PositionalIndex:
    """``postings(row, pos, term)`` of the terms asked for, ``docs(row, id, n_words)``, ``frequency(term, total)``.

    The first two are views of ``table``.
    """

    table: DataFrame
    postings: DataFrame
    docs: DataFrame
    frequency: DataFrame

    def drop(self) -> None:
        dropped(self.table)
        dropped(self.frequency)


def positional_index(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> PositionalIndex:
    """One pass over the texts writes the postings of ``terms`` and one closing row per document with its number of words.

    Texts are not shuffled. A posting is a row and not part of a list, so a term that makes up a third of the corpus
    is spread over all files like any other.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                       words_of(whole_text(text_col)).alias("words"))
    placed = rows.select("row", "id", F.posexplode(F.array_append("words", F.lit(None).cast("string"))).alias("pos", "word"))
    placed = placed.withColumn("word", lowered(F.col("word"))).join(at_most(terms), "word", "left")
    last = F.col("word").isNull()
    kept = placed.where(last | F.col("term").isNotNull()).select("row", F.when(last, F.col("id")).alias("id"), "pos", "term")
    table = written(kept, "postings")
    postings = table.where("term IS NOT NULL").select("row", "pos", "term")
    ends = table.where("term IS NULL").select("row", "id", F.col("pos").cast("long").alias("n_words"))
    frequency = written(postings.groupBy("term").agg(F.count(F.lit(1)).alias("total")), "frequency")
    return PositionalIndex(table, postings, ends, frequency)


def ranked_slots(slots: DataFrame, frequency: DataFrame) -> DataFrame:
    """Slots of windows whose words all occur, with ``rank`` 1 for the window's rarest word."""
    counted = slots.join(frequency, "term", "left")
    whole = Window.partitionBy("window")
    ranked = counted.withColumn("rank", F.row_number().over(whole.orderBy("total", "offset"))).withColumn(
        "known", F.count("total").over(whole))
    return ranked.where(F.col("known") == F.col("length")).select("window", "length", "offset", "term", "rank")


def intersect(places: DataFrame, slots: DataFrame, postings: DataFrame, slop: int) -> DataFrame:
    """Of ``places(row, window, start)``, those at which every slot's list has a posting within ``slop`` of its offset."""
    apart = F.explode(F.array(*map(F.lit, range(-slop, slop + 1))))
    lists = slots.withColumn("lists", F.count(F.lit(1)).over(Window.partitionBy("window")))
    asked = places.join(at_most(lists.select("window", "offset", "term", "lists")), "window").select(
        "row", "window", "start", "offset", "term", "lists", apart.alias("apart")).withColumn(
        "pos", F.col("start") + F.col("offset") + F.col("apart"))
    met = asked.join(postings, ["row", "pos", "term"]).groupBy("row", "window", "start").agg(
        F.count_distinct("offset").alias("met") if slop else F.count(F.lit(1)).alias("met"), F.first("lists").alias("lists"))
    return met.where("met = lists").select("row", "window", "start")


def phrase_places(index: PositionalIndex, slots: DataFrame, slop: int = 0) -> DataFrame:
    """Places of windows in the indexed texts: ``row, window, start, length``.

    With ``slop`` 0 these are exact phrases. Otherwise a place of the window's rarest word (the one with the fewest postings, the
    first of equals) is a proximity match if every other word stands at most ``slop`` places from where the phrase would have it.

    The postings of the rarest word, moved by its offset, are the first places. The second rarest list thins them
    out; the others are then looked up in the rows that are left.
    """
    ranked = written(ranked_slots(slots, index.frequency), "ranked")
    first = ranked.where("rank = 1").select("term", "window", "offset", "length")
    places = index.postings.join(at_most(first.select("term", "window", "offset")), "term").select(
        "row", "window", (F.col("pos") - F.col("offset")).alias("start"))
    second = ranked.where("rank = 2")
    rare = index.postings.join(at_most(second.select("term").distinct()), "term", "left_semi")
    single = written(places.join(at_most(first.where("length = 1").select("window")), "window", "left_semi"), "places")
    paired = written(intersect(places, second, rare, slop), "places")
    rest = ranked.where("rank > 2")
    long = paired.join(at_most(first.where("length > 2").select("window")), "window", "left_semi")
    near = index.postings.join(at_most(long.select("row").distinct()), "row", "left_semi")
    found = intersect(long, rest, near, slop)
    short = paired.join(at_most(first.where("length = 2").select("window")), "window", "left_semi")
    every = single.unionByName(short).unionByName(found).join(at_most(first.select("window", "length")), "window")
    matches = written(every.select("row", "window", "start", "length"), "matches")
    for table in (ranked, single, paired):
        dropped(table)
    return matches


def covered_words(places: DataFrame) -> DataFrame:
    """Words of each row inside any place: ``row, n_hit``. A row's places are at most as many as its words."""
    longest = places.groupBy("row", "start").agg(F.max("length").alias("length")).withColumn("end", F.col("start") + F.col("length"))
    before = F.max("end").over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0)))
    return longest.withColumn("new", F.greatest(new, F.lit(0))).groupBy("row").agg(F.sum("new").cast("long").alias("n_hit"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", size: int = WINDOW_WORDS, slop: int = 0) -> DataFrame:
    """What each document holds of the items, by windows of ``size`` words.

    Returns one row per row of ``docs``: ``id_col, n_words, n_hit`` (words inside a window's place), ``n_items``
    (items with a window found), ``items_sha256`` (of their ids, sorted as strings and comma-joined) and ``contaminated``.

    Null and empty texts have no words; items without words are never found. An id may stand on several rows: each row of
    ``docs`` is a document of its own, rows of one item id count as one item, a null item id is the empty string.
    Other columns are left out. No documents give no rows, no items no hits. ``slop`` as in :func:`phrase_places`.
    """
    windows = item_windows(items, item_col, item_text_col, size)
    index = positional_index(docs, windows.terms, id_col, text_col)
    places = phrase_places(index, windows.slots, slop)
    rows = written(index.docs, "documents")
    index.drop()
    named = places.select("row", "window").distinct().join(at_most(windows.items), "window")
    named = named.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("found"))
    hits = covered_words(places).join(named, "row")
    rows = rows.join(hits, "row", "left")
    found = F.coalesce("found", F.array().cast("array<string>"))
    return rows.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(found).cast("long").alias("n_items"), F.sha2(F.array_join(found, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
