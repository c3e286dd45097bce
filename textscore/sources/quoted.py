"""Quoted tables read by many tasks: a file is cut after line breaks, and whether a line begins a row follows from the state its block starts in."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textscore.session import via_table

# The helpers below travel with the task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: From inside quotes to the end of the cell: text, the closing quote, what stands behind it.
REST = re.compile(rb'(?:[^"]|"")*+(?:"([^\t]*\t?))?', re.S)
#: Cells without an opening quote, as far as there are any.
PLAIN = re.compile(rb'(?:[^"\t][^\t]*(?:\t|$)|\t)*+', re.S)
BATCH_BYTES = 4 << 20
KINDS = "file string, block long, line long, kind string, value binary"


def open_after(line: bytes, quoted: bool) -> bool:
    """Whether a quoted cell is open at the end of a line that begins inside one, or at the start of a row."""
    if b'"' not in line:
        return quoted
    at = 0
    while True:
        if quoted:
            rest = REST.match(line, at)
            if rest.group(1) is None:
                return True
            at, quoted = rest.end(), False
            if not rest.group(1).endswith(b"\t"):
                return False
        at = PLAIN.match(line, at).end()
        if at >= len(line):
            return False
        at, quoted = at + 1, True


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, for both states it may start in: the state at its end, and the line of its first row; and how its first line ends."""
    found: dict[tuple[str, int], list] = {}
    lines: dict[tuple[str, int], int] = {}
    returns: list[bool] = []
    for file, block, line in _by_block(batches):
        states = found.setdefault((file, block), [False, None, True, None])
        number = lines[file, block] = lines.get((file, block), -1) + 1
        if not number:
            returns.append(line.endswith(b"\r"))
        for k in (0, 2):
            if not states[k] and states[k + 1] is None and line.rstrip(b"\r"):
                states[k + 1] = number
            states[k] = open_after(line, states[k])
    names = ("plain_ends", "plain_first", "quoted_ends", "quoted_first")
    if found:
        yield pa.RecordBatch.from_pydict({
            "file": pa.array([f for f, _ in found], pa.string()), "block": pa.array([b for _, b in found], pa.int64()),
            "returns": pa.array(returns, pa.bool_()), **{n: pa.array([s[i] for s in found.values()], pa.int64() if i % 2 else pa.bool_()) for i, n in enumerate(names)}})


def starts_of(blocks: list) -> tuple[dict[tuple[str, int], tuple[bool, bool]], dict[str, tuple[int, int]]]:
    """The state each block starts in and whether ``\\r\\n`` ends the lines of its file; the place of the first row of each file."""
    starts, first, file, quoted, returns = {}, {}, None, False, False
    for r in blocks:
        if r["file"] != file:
            file, quoted, returns = r["file"], False, r["returns"]
        starts[r["file"], r["block"]] = quoted, returns
        kind = "quoted" if quoted else "plain"
        if r[f"{kind}_first"] is not None:
            first.setdefault(file, (r["block"], r[f"{kind}_first"]))
        quoted = r[f"{kind}_ends"]
    return starts, first


def _rows(sent, whole: bool):
    """Rows that lie in one block, or else the parts of those that do not, without headers. ``line`` is the place of a row's first line."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (starts, headers), out, size = sent.value, [], 0
        here, held, quoted, begun, line, first, returns = None, [], False, True, -1, 0, False

        def take(kind: str) -> int:
            if whole != (kind == "whole") or begun and headers.get(here[0]) == (here[1], first):
                return 0
            text = b"\n".join(held)
            out.append((*here, first, kind, text))
            return len(text)

        def made() -> pa.RecordBatch:
            schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("line", pa.int64()), ("kind", pa.string()), ("value", pa.binary())])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for file, block, text in _by_block(batches):
            if (file, block) != here:
                if held:
                    size += take("head" if begun else "inner")
                here, held, line, first = (file, block), [], -1, 0
                quoted, returns = starts[here]
                begun = not quoted
            line += 1
            if not quoted:
                if not text.rstrip(b"\r"):
                    continue
                first, begun = line, True
            held.append(text.removesuffix(b"\r") if returns else text)
            quoted = open_after(text, quoted)
            if not quoted:
                size += take("whole" if begun else "tail")
                held = []
            if size >= BATCH_BYTES:
                yield made()
                out, size = [], 0
        if held:
            take("head" if begun else "inner")
        if out:
            yield made()

    return run


def read_quoted(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "ISO-8859-1") -> DataFrame:
    """Rows of tab-separated tables with a header line and line breaks in quoted cells, with their places ``_file``, ``_block`` and ``_line``.

    Spark deals a file in byte ranges, cut behind line breaks wherever those stand. A first pass finds for each range whether
    a quoted cell is open at its end, from either state it may start in; composed in order, a row a range, this gives the state
    each range does start in. A second pass takes the parts of rows across ranges, which are joined, and the last one the
    whole rows, which go on without a shuffle. Quotes are doubled inside a quoted cell and mean nothing inside a plain one; empty lines
    are skipped, the first row of every file is its header, which is left out where it is read. The first line of a file tells whether ``\\n`` or ``\\r\\n`` ends its lines, which is ``\\n`` inside cells; the encoding has one byte a character
    for tab, quote and line breaks. A compressed file is one range.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    kind = "file string, block long, returns boolean, plain_ends boolean, plain_first long, quoted_ends boolean, quoted_first long"
    found = starts_of(lines.mapInArrow(_ends, kind).orderBy("file", "block").collect())  # a row for each range of a file
    sent = spark.sparkContext.broadcast(found)
    parts = via_table(lines.mapInArrow(_rows(sent, False), KINDS), "parts")
    begins = F.last(F.when(F.col("kind") == "head", F.struct("block", "line")), ignorenulls=True)
    in_order = Window.partitionBy("file").orderBy("block", F.when(F.col("kind") == "head", 1).otherwise(0))  # two rows a range at most
    joined = parts.withColumn("begin", begins.over(in_order)).where("begin IS NOT NULL").groupBy("file", "begin").agg(
        F.array_sort(F.collect_list(F.struct("block", F.decode("value", encoding).alias("value")))).alias("parts"))
    joined = joined.select("file", "begin.block", "begin.line", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value"))
    whole = lines.mapInArrow(_rows(sent, True), KINDS).select("file", "block", "line", F.decode("value", encoding).alias("value"))
    rows = whole.unionByName(joined)
    options = {"sep": "\t", "quote": '"', "escape": '"', "multiLine": "true"}
    cells = F.from_csv("value", schema.toDDL(), options)
    return rows.select(cells.alias("row"), F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("line").alias("_line")).select(
        "row.*", "_file", "_block", "_line")
