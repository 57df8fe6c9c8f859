"""12. Vector code compression with adaptive distance bounds.

Vectors become integers, floor(4096 * x), and are cut into ``PARTS`` equal
parts; each part position has a codebook of ``ENTRIES`` entries that is refined
by rounds of exact nearest assignment and componentwise floored means.

Most parts keep their entry in most rounds, and bounds prove it without a
distance. Each part's state, written with its vector after every round, is

* its entry and an upper bound of the distance to it;
* the ``b`` closest other entries in order, each with a lower bound;
* one outer lower bound for all entries beyond those.

When the entries have moved, the upper bound grows by its entry's drift, the
lower bounds shrink by theirs, the outer one by the largest. A part whose upper
bound is below all lower bounds stays. Otherwise the distance to its entry is
computed, and then only those to as many of the ordered entries as could be
nearer; if not even the outer bound holds, to all. ``b`` starts at a quarter of
the entries and adapts down to what the last round needed, an eighth at least;
bounds that fall away join the outer one. Bounds are 32-bit floats, always
rounded outwards; every decision that they leave open is made on exact
integers, with ties to the lower index.

A round is one pass over the written state and one aggregation of sums; the
driver gets ``ENTRIES`` x dimensions sums. A state's table is deleted when its
successor has been written.

Cases: rows whose vector is null or holds a null, NaN or infinite component are
dropped; so are vectors whose length is not the most common one (the smaller of
equally common ones). A length that ``PARTS`` does not divide gives the first
parts one component more. Integers are held within what lets a squared distance
fit 64 bits (|x| of about 46,000 at 64 dimensions). Rows with a null vec_id
start a codebook only after all others; rows with equal vec_id do so in order
of their components. With fewer rows than entries, the codebooks have as many
entries as there are rows. Repeated rows count each time; an empty table gives
an empty result; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from revisio.llm.common import on_workers, read_table, remove, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Labels whose sums are joined by a broadcast (about 40 bytes each).
MAX_BROADCAST = 100_000
#: Rows that a task works on at once.
ROWS = 4096


def quantized(vectors: DataFrame, vector: str = "embedding", label: str = "label") -> tuple[DataFrame, int]:
    """``vec_id, label, q`` of the rows that are kept, and the dimension."""
    v = vectors[vector].cast("array<double>")
    d = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors[label].alias("label"), v.alias("v")) \
        .filter(F.col("v").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))
    common = d.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "d").first()
    size = common["d"] if common else 0
    most = float(math.isqrt((2 ** 63 - 1) // (4 * max(1, size))))
    most = min(most, 2.0 ** 31 - 1)
    q = F.transform("v", lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(F.greatest(F.lit(-2.0 ** 40), F.least(F.lit(2.0 ** 40), x)) * SCALE)
                                                                    .cast("double"))).cast("int"))
    return d.filter(F.size("v") == size).select("vec_id", "label", q.alias("q")), size


def cuts(size: int) -> list[tuple[int, int]]:
    """The parts' places in a vector."""
    ends = [(size // PARTS) * (p + 1) + min(p + 1, size % PARTS) for p in range(PARTS)]
    return list(zip([0, *ends[:-1]], ends))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x, dtype=np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x, dtype=np.float32), np.float32(-np.inf))


def _squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows (n, m) from entries (k, m), or from rows' own (n, k, m)."""
    apart = x[:, None, :] - entries
    return np.einsum("nkm,nkm->nk", apart, apart)


class Bounds:
    """The state of some rows' parts at one position: ``code`` (n), ``upper``
    (n), ``near`` and ``lower`` (n, b), ``outer`` (n)."""

    def __init__(self, code, upper, near, lower, outer):
        self.code, self.upper, self.near, self.lower, self.outer = code, upper, near, lower, outer

    @classmethod
    def exact(cls, x: np.ndarray, entries: np.ndarray, b: int) -> "Bounds":
        """All distances: the nearest entry, the ``b`` next ones, and the rest's least."""
        d2 = _squared(x, entries[None])
        order = np.argsort(d2, axis=1, kind="stable")  # ties to the lower index
        d = np.sqrt(np.take_along_axis(d2, order, axis=1).astype(np.float64))
        outer = _down(d[:, b + 1]) if len(entries) > b + 1 else np.full(len(x), np.inf, dtype=np.float32)
        return cls(order[:, 0].astype(np.uint8), _up(d[:, 0]), order[:, 1:b + 1].astype(np.uint8), _down(d[:, 1:b + 1]), outer)

    def moved(self, drift: np.ndarray, b: int) -> None:
        """After the entries moved by ``drift`` (rounded up), with ``b`` bounds from now on."""
        if b < self.near.shape[1]:
            self.outer = np.minimum(self.outer, self.lower[:, b:].min(axis=1))
            self.near, self.lower = self.near[:, :b].copy(), self.lower[:, :b].copy()
        self.upper = _up(self.upper + drift[self.code])
        self.lower = _down(self.lower - drift[self.near])
        self.outer = _down(self.outer - drift.max())

    def assign(self, x: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Give every row its nearest entry; returns how many ordered entries
        were needed: -1 none, b + 1 if all were."""
        b = self.near.shape[1]
        needed = np.full(len(x), -1, dtype=np.int64)
        # Least lower bound from each ordered place on.
        least = np.minimum.accumulate(np.concatenate([self.lower, self.outer[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
        open_ = np.flatnonzero(self.upper >= least[:, 0])
        if len(open_):
            d2 = _squared(x[open_], entries[self.code[open_]][:, None])[:, 0]
            self.upper[open_] = _up(np.sqrt(d2.astype(np.float64)))
            sure = self.upper[open_, None] < least[open_]
            # The first place from which all bounds hold; after the last: all entries are needed.
            place = np.where(sure.any(axis=1), sure.argmax(axis=1), b + 1)
            needed[open_] = place
            for z in range(1, b + 1):
                self._among(x, entries, open_[place == z], d2[place == z], z)
            every = open_[place == b + 1]
            if len(every):
                fresh = Bounds.exact(x[every], entries, b)
                for name in ("code", "upper", "near", "lower", "outer"):
                    getattr(self, name)[every] = getattr(fresh, name)
        return needed

    def _among(self, x: np.ndarray, entries: np.ndarray, rows: np.ndarray, own: np.ndarray, z: int) -> None:
        """Decide between the rows' entries and their ``z`` first others."""
        if not len(rows):
            return
        which = np.concatenate([self.code[rows, None], self.near[rows, :z]], axis=1)
        d2 = np.concatenate([own[:, None], _squared(x[rows], entries[which[:, 1:]])], axis=1)
        order = np.lexsort((which, d2), axis=1)
        which, d = np.take_along_axis(which, order, axis=1), np.sqrt(np.take_along_axis(d2, order, axis=1).astype(np.float64))
        self.code[rows], self.upper[rows] = which[:, 0], _up(d[:, 0])
        self.near[rows, :z], self.lower[rows, :z] = which[:, 1:], _down(d[:, 1:])


_STATE = ("code", "upper", "near", "lower", "outer")
_DTYPES = (np.uint8, np.float32, np.uint8, np.float32, np.float32)


def _vectors(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def _packed(parts: list[np.ndarray]) -> pa.Array:
    """One binary a row from an array for each part."""
    raw = np.ascontiguousarray(np.stack([p.reshape(len(p), -1) for p in parts], axis=1))
    return pa.array([r.tobytes() for r in raw], pa.binary())


def _unpacked(column: pa.Array, dtype, each: int | None) -> list[np.ndarray]:
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)
    raw = raw.reshape(len(column), PARTS, -1) if each is None else raw.reshape(len(column), PARTS)
    return [raw[:, p].copy() for p in range(PARTS)]


def _assigned(state: DataFrame, books: list[np.ndarray], drift: list[np.ndarray] | None, b: int, size: int) -> DataFrame:
    """``vec_id, label, q``, the bounds after the assignment, and ``needed``:
    the most ordered entries that one of the row's parts needed."""
    spark, has_state = state.sparkSession, "code" in state.columns
    shared, places = spark.sparkContext.broadcast((books, drift)), cuts(size)
    # Without a third entry there is nothing to keep in order.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, moves = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                q = _vectors(batch.column(2), size)
                old = {n: _unpacked(batch.column(3 + i), t, 1 if n in ("code", "upper", "outer") else None)
                       for i, (n, t) in enumerate(zip(_STATE, _DTYPES))} if has_state else None
                done, needed = [], np.full(len(q), -1, dtype=np.int64)
                for p, (lo, hi) in enumerate(places):
                    x = q[:, lo:hi]
                    if old is None:
                        part = Bounds.exact(x, entries[p], b)
                    else:
                        part = Bounds(*(old[n][p] for n in _STATE))
                        part.moved(moves[p], b)
                        needed = np.maximum(needed, part.assign(x, entries[p]))
                    done.append(part)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], *[_packed([getattr(x, n) for x in done]) for n in _STATE], pa.array(needed.astype(np.int32))],
                    ["vec_id", "label", "q", *_STATE, "needed"])

    schema = StructType([*state.select("vec_id", "label").schema.fields, StructField("q", ArrayType(IntegerType())),
                         *[StructField(n, BinaryType()) for n in _STATE], StructField("needed", IntegerType())])
    columns = ["vec_id", "label", "q", *(_STATE if has_state else ())]
    return state.select(*columns).mapInArrow(run, schema)


def _sums(state: DataFrame, n_entries: int, size: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> (parts assigned to it, sums of their components)."""
    places = cuts(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((n_entries, size), dtype=np.int64), np.zeros((n_entries, PARTS), dtype=np.int64)
        for batch in batches:
            q, codes = _vectors(batch.column(0), size), _unpacked(batch.column(1), np.uint8, 1)
            for p, (lo, hi) in enumerate(places):
                for e in range(n_entries):
                    mine = codes[p] == e
                    totals[e, lo:hi] += q[mine, lo:hi].sum(axis=0)
                    counts[e, p] += mine.sum()
        at = [(p, e, lo + i) for p, (lo, hi) in enumerate(places) for e in range(n_entries) for i in range(hi - lo) if counts[e, p]]
        at += [(p, e, -1) for p in range(PARTS) for e in range(n_entries) if counts[e, p]]
        values = [int(counts[e, p] if i < 0 else totals[e, i]) for p, e, i in at]
        yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in at], pa.int32()) for k in range(3)), pa.array(values, pa.int64())],
                                         ["part", "entry", "i", "value"])

    rows = state.select("q", "code").mapInArrow(run, "part int, entry int, i int, value long") \
        .groupBy("part", "entry", "i").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    found: dict[tuple[int, int], dict[int, int]] = {}
    for r in rows:
        found.setdefault((r["part"], r["entry"]), {})[r["i"]] = int(r["value"])
    return {k: (v[-1], [v[i] for i in range(*places[k[0]])]) for k, v in found.items()}


def _refined(books: list[np.ndarray], sums: dict) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The next codebooks, and how far each entry moved, rounded up."""
    out, drift = [], []
    for p, book in enumerate(books):
        new = book.copy()
        for e in range(len(book)):
            if (p, e) in sums:
                n, total = sums[p, e]
                new[e] = [t // n for t in total]
        out.append(new)
        moved = np.sqrt(((new - book) ** 2).sum(axis=1).astype(np.float64))
        drift.append(np.where(moved > 0, _up(moved), np.float32(0)).astype(np.float32))
    return out, drift


def _adapted(state: DataFrame, b: int) -> int:
    """As many ordered entries as the round needed, where not all were needed; an eighth of the entries at least."""
    most = state.filter(F.col("needed").between(0, b)).agg(F.max("needed")).first()[0]
    return min(b, max(ENTRIES // 8, most if most is not None else 0))


def compress(vectors: DataFrame, vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """``vec_id, label, code, error`` for each kept row, and the final codebooks
    (for each part its entries' integer components)."""
    spark = vectors.sparkSession
    on_workers(spark)
    kept, size = quantized(vectors, vector, label)
    kept = written(kept, "codes-vectors")
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(ENTRIES).select("q").collect()
    first = np.asarray([r["q"] for r in seeds], dtype=np.int64).reshape(len(seeds), size)
    books = [first[:, lo:hi] for lo, hi in cuts(size)]
    if not seeds:
        empty = kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty, books
    b = min(ENTRIES // 4, max(0, len(seeds) - 1))
    state, drift = kept, None
    for _ in range(rounds):
        old, state = state, written(_assigned(state, books, drift, b, size), "codes-state")
        remove(old)
        if drift is not None:
            b = _adapted(state, b)
        books, drift = _refined(books, _sums(state, len(seeds), size))
    last = _assigned(state, books, drift, b, size)
    shared, places = spark.sparkContext.broadcast(books), cuts(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value
        for batch in batches:
            q, codes = _vectors(batch.column(2), size), _unpacked(batch.column(3), np.uint8, 1)
            error = np.zeros(len(q), dtype=np.int64)
            for p, (lo, hi) in enumerate(places):
                error += ((q[:, lo:hi] - entries[p][codes[p]]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([x.hex() for x in batch.column(3).to_pylist()], pa.string()), pa.array(error)],
                                             ["vec_id", "label", "code", "error"])

    schema = StructType([*kept.select("vec_id", "label").schema.fields, StructField("code", kept.select(F.lit("")).schema[0].dataType), StructField("error", LongType())])
    coded = written(last.select("vec_id", "label", "q", "code").mapInArrow(run, schema), "codes")
    remove(state)
    return coded, books


def codebooks_digest(books: list[np.ndarray]) -> str:
    text = ",".join(str(int(x)) for book in books for entry in book for x in entry)
    return hashlib.sha256(text.encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``label_error`` besides: the errors' sum over equal labels, nulls together (at most a long's largest)."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2 ** 63 - 1).cast("decimal(38,0)")).cast("long")
    sums = written(coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "_of"), "codes-labels")
    if sums.count() <= MAX_BROADCAST:
        sums = F.broadcast(sums)
    return coded.join(sums, coded["label"].eqNullSafe(sums["_of"])).drop("_of")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(read_table(spark, sf_dir, "embeddings"))
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
