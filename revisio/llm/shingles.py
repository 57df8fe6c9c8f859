"""Sets of hashed word shingles, computed for many texts at once with numpy.

Words are runs of bytes that are not ASCII white space, with A-Z lowered. A
word's 64-bit hash is a polynomial over random byte values, taken from prefix
sums over the whole block; shingles mix the hashes of their words.
"""
from __future__ import annotations

import numpy as np

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    lowered = np.arange(256, dtype=np.uint64)
    lowered[65:91] += np.uint64(32)
    with np.errstate(over="ignore"):
        return _mix((lowered + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


_VALUES = _byte_values()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of them."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(int(_BASE), -1, 1 << 64)
        for name, base in (("up", int(_BASE)), ("down", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes in order, and the place of each text's first word (and the end)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    begins = np.cumsum([0] + [len(r) + 1 for r in raw])
    space = _SPACES[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * up[:len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    return _mix(hashes ^ (ends - starts).astype(np.uint64)), np.searchsorted(starts, begins)


def _chain(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    out = hashes[:len(hashes) - size + 1].copy()
    for k in range(1, size):
        out = _mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[k:len(hashes) - size + 1 + k])
    return out


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted; a text of fewer words is one shingle."""
    if not texts:
        return []
    hashes, at = word_hashes(texts)
    runs = _chain(hashes, size) if len(hashes) >= size else np.zeros(0, dtype=np.uint64)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        n = int(b - a)
        if n >= size:
            out.append(np.unique(runs[a:b - size + 1]))
        else:  # the length is mixed in, as runs of different lengths are different shingles
            out.append(_mix(_chain(hashes[a:b], n) + np.uint64(n)) if n else np.zeros(0, dtype=np.uint64))
    return out
