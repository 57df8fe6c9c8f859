"""Text helpers with Python ``str`` semantics, as native Spark expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.split() / str.strip() treat as
# whitespace (str.isspace()): U+0009-U+000D, U+001C-U+001F, U+0020, U+0085,
# U+00A0, U+1680, U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
# Written so that Java regex (Spark) and RE2 (DuckDB) read it the same way.
WS_CLASS = (
    r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# The same characters for Java alone: one bit table, and one range test before the others are
# looked at, where the class above is a chain of tests for every character of a text.
WS_JAVA = r"[\t-\r\x1c- \x85\xa0[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c) -> Column:
    """``x.split()``: split on whitespace runs, no empty tokens; null stays null."""
    return F.filter(F.split(_c(c), WS_JAVA + "+"), lambda w: w != F.lit(""))


def first_words(c, n: int) -> Column:
    """``x.split()[:n]``: the text behind them stays one piece, which is dropped
    (a text that begins with whitespace has an empty piece before its words)."""
    return F.slice(F.filter(F.split(_c(c), WS_JAVA + "+", n + 2), lambda w: w != F.lit("")), 1, n)


def n_words(c) -> Column:
    return F.size(words(c))


def strip(c) -> Column:
    """``x.strip()`` (Spark's ``trim`` only removes spaces)."""
    return F.regexp_replace(_c(c), f"^{WS_JAVA}+|{WS_JAVA}+$", "")


def collapse_spaces(c) -> Column:
    """Join the words of ``c`` with single spaces."""
    return F.array_join(words(c), " ")


def materialize(df, cols: dict):
    """Add computed columns behind an optimisation barrier.

    Catalyst collapses adjacent projections and may inline an expression into
    every evaluation of a higher-order-function lambda that reads it (an
    O(n) expression read per word becomes O(n^2)). Producing the columns
    through a one-row ``inline`` (a Generate node) keeps them computed once
    per row.
    """
    from pyspark.sql import functions as F
    return df.select("*", F.inline(F.array(F.struct(*[e.alias(n) for n, e in cols.items()]))))
