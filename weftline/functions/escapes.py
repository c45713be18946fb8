"""One-line text: a reversible escape for text that goes into files with one row per line.

A backslash starts a pair in escaped text, and its second character is never a backslash, so that
each pair can be undone by one replacement. Null has a pair of its own, which no text escapes to.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: In the order of escaping: what later pairs are made with comes first.
PAIRS = (("\\", "\\s"), ("\n", "\\n"), ("\r", "\\r"), ("\0", "\\0"))
EMPTY, NULL = "\\e", "\\N"


def escape(col: Column) -> Column:
    for plain, pair in PAIRS:
        col = F.replace(col, F.lit(plain), F.lit(pair))
    return F.when(col == "", EMPTY).otherwise(col)


def unescape(col: Column) -> Column:
    text = col
    for plain, pair in reversed(PAIRS):
        text = F.replace(text, F.lit(pair), F.lit(plain))
    return F.when(col == EMPTY, "").when(col != NULL, text)


def escape_name(name: str) -> str:
    for plain, pair in PAIRS:
        name = name.replace(plain, pair)
    return name


def unescape_name(name: str) -> str:
    for plain, pair in reversed(PAIRS):
        name = name.replace(pair, plain)
    return name
