"""DuckDB SQL fragments mirroring the library's building blocks.

Written independently of the Spark code (lists are 1-based here, run
numbering uses window sums, etc.) so that agreement means something.
"""
from __future__ import annotations

from typing import Sequence

from revisio.functions.text import WS_CLASS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(WS_CLASS + '+')}), lambda _w: _w <> '')"


def n_words(x: str) -> str:
    return f"len({words(x)})"


def md5key(*parts: str) -> str:
    """md5 over '|'-joined parts; each part is a SQL expression."""
    return "md5(concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"


def u32(hexexpr: str) -> str:
    return f"CAST(('0x' || substr({hexexpr}, 1, 8)) AS BIGINT)"


def h(seed: int, stream: str, row_id: str, purpose: str, *parts: str) -> str:
    return md5key(q(str(seed)), q(stream), row_id, q(purpose), *parts)


def randint(lo: str, hi: str, seed: int, stream: str, row_id: str, purpose: str, *parts: str) -> str:
    return f"(({lo}) + {u32(h(seed, stream, row_id, purpose, *parts))} % (({hi}) - ({lo}) + 1))"


def arr(items: Sequence[str]) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def bounds(x: str, lo=None, hi=None) -> str:
    c = []
    if lo is not None:
        c.append(f"{n_words(x)} > {lo}")
    if hi is not None:
        c.append(f"{n_words(x)} < {hi}")
    return "coalesce(" + " AND ".join(c) + ", false)"


def char_ratio(i: str = "input", o: str = "output") -> str:
    li, lo = f"CAST(length({i}) AS DOUBLE)", f"CAST(length({o}) AS DOUBLE)"
    return (f"coalesce(NOT ({li} > CAST(1.3 AS DOUBLE) * {lo} OR {li} < CAST(0.7 AS DOUBLE) * {lo}), false)")
