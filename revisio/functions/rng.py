"""Seeded, partition-independent random draws.

A draw is ``md5(seed | stream | row_id | purpose | k...)``; its first eight hex
digits give an unsigned 32-bit integer. The same string and the same number
come out of DuckDB (``('0x' || substr(md5(..),1,8))::BIGINT``), which is what
lets every random operator have an exact SQL oracle. ``rand()`` and
``monotonically_increasing_id()`` are never used: they change when a task is
retried or the data is repartitioned.
"""
from __future__ import annotations

from typing import Union

from pyspark.sql import Column
from pyspark.sql import functions as F

Part = Union[Column, str, int]


def _s(p: Part) -> Column:
    if isinstance(p, Column):
        return p.cast("string")
    return F.lit(str(p))


def draw_key(seed: int, stream: str, row_id: Part, purpose: str, *parts: Part) -> Column:
    """The text that is hashed for one draw (kept separate for the oracle)."""
    return F.concat_ws("|", F.lit(str(seed)), F.lit(stream), _s(row_id), F.lit(purpose), *[_s(p) for p in parts])


def h(seed: int, stream: str, row_id: Part, purpose: str, *parts: Part) -> Column:
    """Hex md5 of the draw key: a uniform sort key."""
    return F.md5(draw_key(seed, stream, row_id, purpose, *parts))


def u32(hex_col: Column) -> Column:
    """First 32 bits of a hex digest as a non-negative BIGINT."""
    return F.conv(F.substring(hex_col, 1, 8), 16, 10).cast("bigint")


def randint(lo: Part, hi: Part, seed: int, stream: str, row_id: Part, purpose: str, *parts: Part) -> Column:
    """Uniform integer in [lo, hi] (both inclusive, like ``random.randint``)."""
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    span = (hi_c - lo_c + F.lit(1)).cast("bigint")
    return (lo_c + (u32(h(seed, stream, row_id, purpose, *parts)) % span)).cast("int")
