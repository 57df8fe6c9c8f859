"""Word-level difference opcodes (Ratcliff-Obershelp, stdlib ``difflib``).

This is the one generator kernel with no native Spark form: the matcher
recursively finds longest common blocks. It runs as an ``arrow_udf`` on rows that have already passed every filter, one call per
row, over whole texts (no word limit). ``autojunk`` stays on, as in the
reference behaviour, which keeps long texts near-linear.

The standard library scans the words again at every level of the recursion.
Here the runs of equal words are found once, with numpy, and taken by length
(then by place): a run that still lies whole in one open box is the block that
the recursion would take there, any other is cut to the boxes it touches and
put back. Same opcodes, held against the library in the tests. Texts with more
than ``MAX_PLACES`` pairs of equal words go to the library.
"""
from __future__ import annotations

import difflib
import heapq
import sys
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship this module's code inside the pickled UDF, so executors need no copy of
# the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OPCODE = T.StructType([
    T.StructField("tag", T.StringType()),
    T.StructField("i1", T.IntegerType()),
    T.StructField("i2", T.IntegerType()),
    T.StructField("j1", T.IntegerType()),
    T.StructField("j2", T.IntegerType()),
])
DIFF = T.StructType([
    T.StructField("ops", T.ArrayType(OPCODE)),
    T.StructField("mask", T.ArrayType(T.BooleanType())),
])

TAGS = ["equal", "replace", "delete", "insert"]


#: Pairs of places with equal words (about 100 bytes each) up to which their runs are kept.
MAX_PLACES = 1_000_000


def _runs(a: list, b: list) -> tuple | None:
    """Maximal runs ``a[i:i+n] == b[j:j+n]`` of words that are not too frequent
    in ``b``, as three arrays; None if there are too many places."""
    x, y = np.asarray(a, np.int64), np.asarray(b, np.int64)
    count = np.bincount(y, minlength=int(max(x.max(initial=0), y.max(initial=0))) + 1)
    taken = (count > 0) & (count <= len(y) // 100 + 1) if len(y) >= 200 else count > 0
    i = np.flatnonzero(taken[x])
    each = count[x[i]]
    total = int(each.sum())
    if total > MAX_PLACES:
        return None
    first = np.concatenate([[0], np.cumsum(count)])[x[i]]
    j = np.argsort(y, kind="stable")[np.repeat(first - np.cumsum(each) + each, each) + np.arange(total)]
    i = np.repeat(i, each)
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    begins = np.ones(total, bool)
    begins[1:] = (np.diff(j - i) != 0) | (np.diff(i) != 1)
    at = np.flatnonzero(begins)
    return i[at], j[at], np.diff(np.append(at, total))


def _blocks(a: list, b: list) -> list | None:
    """The matching blocks ``(i, j, n)`` in order; None if there are too many places."""
    found = _runs(a, b)
    if found is None:
        return None
    i0, j0, size = found
    # The boxes that are still open, in order: a[a0:a1] against b[b0:b1].
    a0, a1, b0, b1 = ([0], [len(a)], [0], [len(b)]) if a and b else ([], [], [], [])
    out = []
    while len(size) and a0:
        # Runs of at least half the greatest length; shorter ones, most of which lie in no box by then, wait.
        least = max(1, int(size.max()) // 2) if len(size) > 64 else 1
        now = size >= least
        heap, later = list(zip((-size[now]).tolist(), i0[now].tolist(), j0[now].tolist())), []
        heapq.heapify(heap)
        while heap and a0:
            n, i, j = heapq.heappop(heap)
            n, k = -n, max(0, bisect_right(a0, i) - 1)
            if not (a0[k] <= i and i + n <= a1[k] and b0[k] <= j and j + n <= b1[k]):
                while k < len(a0) and a0[k] < i + n:
                    s, e = max(0, a0[k] - i, b0[k] - j), min(n, a1[k] - i, b1[k] - j)
                    if e - s >= least:
                        heapq.heappush(heap, (s - e, i + s, j + s))
                    elif s < e:
                        later.append((i + s, j + s, e - s))
                    k += 1
                continue
            p, q, r, s = a0[k], a1[k], b0[k], b1[k]
            # Frequent words join a block at its ends.
            while i > p and j > r and a[i - 1] == b[j - 1]:
                i, j, n = i - 1, j - 1, n + 1
            while i + n < q and j + n < s and a[i + n] == b[j + n]:
                n += 1
            out.append((i, j, n))
            before, after = p < i and r < j, i + n < q and j + n < s
            if before:
                a1[k], b1[k] = i, j
                if after:
                    a0.insert(k + 1, i + n)
                    a1.insert(k + 1, q)
                    b0.insert(k + 1, j + n)
                    b1.insert(k + 1, s)
            elif after:
                a0[k], b0[k] = i + n, j + n
            else:
                del a0[k], a1[k], b0[k], b1[k]
        i0, j0, size = (np.concatenate([c[~now], np.array(l, np.int64)]) for c, l in zip((i0, j0, size), zip(*later) if later else [()] * 3))
        # Runs whose words lie in no box on both sides are done.
        first = np.maximum(np.searchsorted(a1, i0, "right"), np.searchsorted(b1, j0, "right"))
        last = np.minimum(np.searchsorted(a0, i0 + size, "left"), np.searchsorted(b0, j0 + size, "left"))
        i0, j0, size = i0[first < last], j0[first < last], size[first < last]
    # A box without a run is matched from its beginning, by frequent words alone.
    for i, q, j, s in zip(a0, a1, b0, b1):
        n = 0
        while i + n < q and j + n < s and a[i + n] == b[j + n]:
            n += 1
        if n:
            out.append((i, j, n))
    return sorted(out)


def _opcodes(a: list, b: list) -> list:
    """``SequenceMatcher(None, a, b).get_opcodes()`` for words that are numbers from 0."""
    blocks = _blocks(a, b)
    if blocks is None:
        return difflib.SequenceMatcher(None, a, b).get_opcodes()
    joined: list = []
    for i, j, n in blocks:
        if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
            i, j, n = joined[-1][0], joined[-1][1], joined.pop()[2] + n
        joined.append((i, j, n))
    out, p, q = [], 0, 0
    for i, j, n in [*joined, (len(a), len(b), 0)]:
        if p < i or q < j:
            out.append(("replace" if p < i and q < j else "delete" if p < i else "insert", p, i, q, j))
        if n:
            out.append(("equal", i, i + n, j, j + n))
        p, q = i + n, j + n
    return out


def _mask(ops: list, n: int) -> list:
    mask = [False] * n
    for tag, i1, i2, _, _ in ops:
        if tag != "equal":
            mask[i1:i2] = [True] * (i2 - i1)
    return mask


def opcodes_and_mask(a: list, b: list):
    """Opcodes turning ``a`` into ``b`` and the mask of ``a`` words not kept."""
    numbers: dict = {}
    ops = _opcodes(*[[numbers.setdefault(w, len(numbers)) for w in side] for side in (a, b)])
    return [dict(tag=t, i1=i1, i2=i2, j1=j1, j2=j2) for t, i1, i2, j1, j2 in ops], _mask(ops, len(a))


def _numbers(x: pa.ListScalar, y: pa.ListScalar) -> tuple[list, list]:
    """The words of two arrays as numbers: equal words have equal numbers, which is all that the matcher looks at."""
    both = pa.concat_arrays([x.values, y.values])
    n = len(x.values)
    numbers = (both if len(both) else both.cast(pa.string())).dictionary_encode().indices.to_pylist()
    return numbers[:n], numbers[n:]


def _lists(lengths: list, values: pa.Array, missing: list) -> pa.Array:
    """A list array from each row's length; ``missing`` rows are null."""
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(missing, False)) if any(missing) else pa.array(offsets), values)


@F.arrow_udf(DIFF)
def _diff_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    """Words are taken a row at a time and results kept as numbers, so that a
    batch costs little beyond its Arrow bytes."""
    tags, places = array("b"), [array("i") for _ in range(4)]
    masks, n_ops, n_words, missing = bytearray(), [], [], []
    for x, y in zip(a, b):
        none = not (x.is_valid and y.is_valid)
        ops, n = [], 0
        if not none:
            left, right = _numbers(x, y)
            ops, n = _opcodes(left, right), len(left)
        missing.append(none)
        n_ops.append(len(ops))
        n_words.append(n)
        masks += bytes(_mask(ops, n))
        for op in ops:
            tags.append(TAGS.index(op[0]))
            for column, place in zip(places, op[1:]):
                column.append(place)
    tag = pa.DictionaryArray.from_arrays(pa.array(np.array(tags, np.int8)), pa.array(TAGS)).cast(pa.string())
    ops = pa.StructArray.from_arrays([tag, *[pa.array(np.array(p, np.int32)) for p in places]], ["tag", "i1", "i2", "j1", "j2"])
    mask = pa.array(np.frombuffer(bytes(masks), np.uint8).astype(bool))
    return pa.StructArray.from_arrays([_lists(n_ops, ops, missing), _lists(n_words, mask, missing)], ["ops", "mask"])


def diff_opcodes(a_words: Column, b_words: Column) -> Column:
    """``STRUCT<ops ARRAY<STRUCT<tag,i1,i2,j1,j2>>, mask ARRAY<BOOLEAN>>``
    for ``SequenceMatcher(None, a_words, b_words)``."""
    return _diff_udf(a_words, b_words)


def full_diff_mask(a_words: Column, b_words: Column) -> Column:
    return diff_opcodes(a_words, b_words)["mask"]
