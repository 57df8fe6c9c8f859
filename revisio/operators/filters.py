"""Row filters. All are native predicates; equality filters on
plain columns reach the Parquet scan as pushed filters."""
from __future__ import annotations

from typing import Iterable, Optional, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revisio.functions.text import n_words

SPAN_PATTERN = r"(?d)<S>(.*?)</S>"  # Fixed value: one annotated span, '.' stops at '\n'.


def word_bounds(col: str, lo: Optional[int] = None, hi: Optional[int] = None) -> Column:
    """``lo < len(col.split()) < hi``; either bound may be absent. Null text fails."""
    n = n_words(col)
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (n > lo)
    if hi is not None:
        cond = cond & (n < hi)
    return F.coalesce(cond, F.lit(False))


def filter_word_bounds(df: DataFrame, bounds: Sequence[tuple]) -> DataFrame:
    """``bounds`` is a list of ``(column, lo, hi)``; all must hold."""
    cond = F.lit(True)
    for col, lo, hi in bounds:
        cond = cond & word_bounds(col, lo, hi)
    return df.filter(cond)


def char_ratio_ok(inp: str = "input", out: str = "output", lo: float = 0.7, hi: float = 1.3) -> Column:
    """Keep unless ``len(in) > hi*len(out)`` or ``len(in) < lo*len(out)`` (doubles)."""
    li = F.length(inp).cast("double")
    lo_ = F.length(out).cast("double")
    return F.coalesce(~((li > F.lit(hi) * lo_) | (li < F.lit(lo) * lo_)), F.lit(False))


def filter_char_ratio(df: DataFrame, inp: str = "input", out: str = "output",
                      lo: float = 0.7, hi: float = 1.3) -> DataFrame:
    return df.filter(char_ratio_ok(inp, out, lo, hi))


def filter_residual_edits(df: DataFrame, col: str, max_size: int = 1) -> DataFrame:
    """Keep rows whose list ``col`` has fewer than ``max_size`` items
    (``max_size=1`` is ``col == []``)."""
    return df.filter(F.coalesce(F.size(col) < max_size, F.lit(False)))


def filter_label(df: DataFrame, col: str, value: str) -> DataFrame:
    return df.filter(F.col(col) == F.lit(value))


def filter_not_null(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return df.filter(cond)


def single_span(col: str, pattern: str = SPAN_PATTERN) -> Column:
    return F.coalesce(F.regexp_count(F.col(col), F.lit(pattern)) == 1, F.lit(False))


def filter_single_span(df: DataFrame, col: str, pattern: str = SPAN_PATTERN) -> DataFrame:
    """Exactly one non-greedy ``<S>...</S>`` span that does not cross a newline."""
    return df.filter(single_span(col, pattern))


def filter_intent_prefix(df: DataFrame, col: str, intent: str) -> DataFrame:
    """Rows whose text starts with ``<intent>``; other rows are dropped one by one."""
    return df.filter(F.coalesce(F.col(col).startswith(f"<{intent}>"), F.lit(False)))


def non_empty_pair(a: str, b: str) -> Column:
    return (F.coalesce(F.length(a), F.lit(0)) > 0) & (F.coalesce(F.length(b), F.lit(0)) > 0)


def drop_empty_pairs(df: DataFrame, a: str = "input", b: str = "output") -> DataFrame:
    """Drop a row if either side is null or empty."""
    return df.filter(non_empty_pair(a, b))


def filter_split(df: DataFrame, splits: Sequence[str], split_col: str = "split",
                 check: bool = False) -> DataFrame:
    """Keep the named splits. With ``check`` a missing split fails the job that
    reads the result: one row of counts (a partial aggregate over the split
    column alone) is joined to the rows and must hold every name. Nothing runs
    while the plan is built."""
    kept = df.filter(F.col(split_col).isin(list(splits)))
    if not check:
        return kept
    seen = F.array_except(F.array(*[F.lit(s) for s in splits]), F.collect_set(split_col))
    verdict = df.groupBy().agg(seen.alias("_missing")).select(
        F.lit(1).alias("_one"),
        F.assert_true(F.size("_missing") == 0, F.concat(F.lit("missing split(s): "), F.array_join("_missing", ", "))).isNull().alias("_ok"))
    # An outer join, so that the check is met even if no row is kept.
    joined = verdict.join(kept.withColumn("_one", F.lit(1)), "_one", "left")
    return joined.filter(F.col("_ok") & F.col(split_col).isNotNull()).select(*df.columns)
