"""Text expressions shared by the operators. All of them run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as blanks (those of ``str.isspace``),
# written as a regex class that the Java and RE2 dialects both accept.
BLANK = (
    r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

BLANK_CHARS = [ch for ch in map(chr, range(0x3001)) if ch.isspace()]

# The entity tags of the essay corpus.
ENTITY_TAGS = (
    "@CAPS", "@CITY", "@DATE", "@DR", "@EMAIL", "@LOCATION", "@MONEY",
    "@MONTH", "@NUM", "@ORGANIZATION", "@PERCENT", "@PERSON", "@STATE", "@TIME",
)

# An entity token with and without its running number.
ENTITY_TOKEN = "@+[A-Z]+[0-9]*"
ENTITY_TYPE = "@+[A-Z]+"

PADDING_TOKEN = "<PAD>"
PADDING_ID = 0


def split_blanks(x: Column) -> Column:
    """Words between runs of blanks. Blanks at the ends give empty words."""
    return F.split(x, BLANK + "+")


def lower_by_char(x: Column) -> Column:
    """Lowercase character by character.

    Java lowers a capital sigma at the end of a word to its final form; doing
    the sigma first keeps the mapping free of context.
    """
    return F.lower(F.replace(x, F.lit("Σ"), F.lit("σ")))


def _java_alternatives(tokens) -> str:
    longest_first = sorted(tokens, key=lambda t: (-len(t), t))
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", t) for t in longest_first)


def piece_pattern(special=(), gaps: bool = False) -> str:
    """Java regex for pretokens: word runs and punctuation runs.

    With ``special`` the special tokens are cut out first, wherever they
    stand. With ``gaps`` the blanks between pretokens are matched as well, so
    that the matches cover the whole text.
    """
    if special:
        alternatives = _java_alternatives(special)
        stop = f"(?!{alternatives})"
        parts = [alternatives, rf"(?:{stop}\w)+", rf"(?:{stop}[^\w\s])+"]
    else:
        parts = [r"\w+", r"[^\w\s]+"]
    if gaps:
        parts.append(r"\s+")
    return "(?U)" + "|".join(parts)


def pretokens(x: Column, special=(), gaps: bool = False) -> Column:
    return F.regexp_extract_all(x, F.lit(piece_pattern(special, gaps)), F.lit(0))


def separate_tags(x: Column, tags=ENTITY_TAGS) -> Column:
    """Put a blank after each tag: ``@CAPS1`` becomes ``@CAPS 1``.

    A first character that all tags share stands before the alternatives, so that other places fail at once,
    and texts without it are left as they are.
    """
    first = {t[:1] for t in tags}
    if len(first) != 1 or not all(tags):
        return F.regexp_replace(x, "(" + "|".join(tags) + ")", "$1 ")
    head = first.pop()
    found = F.regexp_replace(x, re.escape(head) + "(" + "|".join(t[1:] for t in tags) + ")", head.replace("$", r"\$") + "$1 ")
    return F.when(F.contains(x, F.lit(head)), found).otherwise(x)
