"""JSON arrays read by many tasks: a file is cut after closing braces, and what braces mean follows from the state each block starts in."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textscore.session import via_table

# The helpers below travel with the task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TO_QUOTE = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
STRING = re.compile(r'"(?:[^"\\]|\\.)*("?)', re.S)


def after_piece(piece: str, quoted: bool) -> tuple[bool, int]:
    """Whether a string is open after a piece and the brace behind it, and by how much the depth changed."""
    if quoted:
        end = TO_QUOTE.match(piece)
        if not end:
            return True, 0
        piece = piece[end.end():]
    open_ = False

    def drop(string: re.Match) -> str:
        nonlocal open_
        open_ = not string.group(1)
        return ""

    bare = STRING.sub(drop, piece) if '"' in piece else piece
    change = bare.count("{") - bare.count("}")
    return open_, change if open_ else change - 1


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")))


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, for both states it may start in: the state at its end, and the change of depth."""
    found: dict[tuple[str, int], list] = {}
    for file, block, piece in _by_block(batches):
        states = found.setdefault((file, block), [False, 0, True, 0])
        for k in (0, 2):
            states[k], change = after_piece(piece, states[k])
            states[k + 1] += change
    names = ("plain_ends", "plain_change", "quoted_ends", "quoted_change")
    if found:
        yield pa.RecordBatch.from_pydict({
            "file": pa.array([f for f, _ in found], pa.string()), "block": pa.array([b for _, b in found], pa.int64()),
            **{n: pa.array([s[i] for s in found.values()], pa.int64() if i % 2 else pa.bool_()) for i, n in enumerate(names)}})


def starts_of(blocks: list) -> dict[tuple[str, int], tuple[bool, int]]:
    """The state and depth that each block starts in, by composing the blocks of a file in order."""
    out, file, quoted, depth = {}, None, False, 0
    for r in blocks:
        if r["file"] != file:
            file, quoted, depth = r["file"], False, 0
        out[r["file"], r["block"]] = quoted, depth
        kind = "quoted" if quoted else "plain"
        quoted, depth = r[f"{kind}_ends"], depth + r[f"{kind}_change"]
    return out


def _elements(starts):
    """Elements of each block, the whole ones as they are; one that begins or ends in another block in parts."""
    kinds = {"file": pa.string(), "block": pa.int64(), "line": pa.int64(), "kind": pa.string(), "value": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        here, held, quoted, depth, line, begun = None, [], False, 0, 0, True

        def rest() -> None:
            if here and held and (depth > 0 or quoted):
                out.append((*here, line, "head" if begun else "inner", "}".join(held) + "}"))

        for file, block, piece in _by_block(batches):
            if (file, block) != here:
                rest()
                here, held, line = (file, block), [], 0
                quoted, depth = starts.value[here]
                begun = depth == 0 and not quoted
            held.append(piece)
            quoted, change = after_piece(piece, quoted)
            depth += change
            if depth <= 0 and not quoted:
                text = "}".join(held) + "}"
                out.append((file, block, line, "whole" if begun else "tail", text[text.find("{"):] if begun else text))
                held, depth, begun, line = [], 0, True, line + 1
            if len(out) >= 512:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.values())], list(kinds))
                out.clear()
        rest()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.values())], list(kinds))

    return run


def read_json_arrays(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """Elements of JSON arrays of objects, with their places ``_file``, ``_block`` and ``_line``.

    Spark deals a file in byte ranges, cut behind closing braces wherever those stand. A first pass finds for each range
    how quotes and depth change from either state it may start in; composed in order, a row a range, this gives the state
    each range does start in, and a second pass takes whole elements. An element across ranges comes out in parts that are joined.
    A compressed file is one range. What cannot be parsed has null fields.
    """
    pieces = spark.read.option("lineSep", "}").text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    kind = "file string, block long, plain_ends boolean, plain_change long, quoted_ends boolean, quoted_change long"
    blocks = pieces.mapInArrow(_changes, kind).orderBy("file", "block").collect()  # a row for each range of a file
    starts = spark.sparkContext.broadcast(starts_of(blocks))
    found = via_table(pieces.mapInArrow(_elements(starts), "file string, block long, line long, kind string, value string"), "elements")
    whole = found.where("kind = 'whole'").select("file", "block", "line", "value")
    parts = found.where("kind <> 'whole'")
    begins = F.last(F.when(F.col("kind") == "head", F.struct("block", "line")), ignorenulls=True)
    in_order = Window.partitionBy("file").orderBy("block", F.when(F.col("kind") == "head", 1).otherwise(0))  # two rows a range at most
    joined = parts.withColumn("begin", begins.over(in_order)).groupBy("file", "begin").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "value"))), lambda p: p["value"]), "").alias("value"))
    joined = joined.select("file", "begin.block", "begin.line", F.expr("substring(value, locate('{', value))").alias("value"))
    rows = whole.unionByName(joined).where(F.startswith("value", F.lit("{")))
    rows = rows.select(F.from_json("value", schema).alias("row"), F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("line").alias("_line"))
    return rows.select("row.*", "_file", "_block", "_line")
