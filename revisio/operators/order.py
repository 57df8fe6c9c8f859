"""Order, limits, ranks and splits.

Position is never implicit: order is by an explicit key, and random order is
by a seeded md5 key. Dense global ranks are built without a single-partition
window: rows are grouped into buckets that respect the order (hex-prefix
buckets for hash keys, range partitions for other keys), a small table of
bucket sizes gives each bucket its offset, and ``row_number`` runs per bucket.
Where only rows before (or between) certain places are wanted, the keys at
those places are found on a narrow written table of keys, and the rows are then
kept or dropped where they stand, by plain comparisons.
"""
from __future__ import annotations

import math
from typing import Callable, Optional, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revisio.functions.rng import h
from revisio.session import removed, written

#: Rows of the last step of a search by place, which are sorted by one task.
SMALL = 10_000
# Hex digits of a rank's buckets: at most 16^4 offsets, whatever the data.
BUCKET_DIGITS = 4


def shuffle_key(seed: int, row_id: str = "row_id", *parts: str, stream: str = "shuffle") -> Column:
    return h(seed, stream, F.col(row_id), "sh", *[F.col(p) for p in parts])


def shuffle_rows(df: DataFrame, seed: int, row_id: str = "row_id", parts: Sequence[str] = ()) -> DataFrame:
    """Seeded random permutation as a total order (range-partitioned sort)."""
    return df.orderBy(shuffle_key(seed, row_id, *parts), *[F.col(c) for c in (row_id, *parts)])


def shuffle_for_write(df: DataFrame, seed: int, row_id: str = "row_id", parts: Sequence[str] = (), tasks: Optional[int] = None) -> DataFrame:
    """Random order for writing: rows are dealt by a seeded hash and ordered by
    it in each task (no range sampling pass). The number of tasks is the
    planner's, which adapts it to the bytes, unless ``tasks`` is given (for rows
    that get their bytes after the shuffle)."""
    k = shuffle_key(seed, row_id, *parts)
    return df.withColumn("_sk", k).repartition(*([tasks] if tasks else []), "_sk").sortWithinPartitions("_sk").drop("_sk")


def head_rows(df: DataFrame, n: int, order_cols: Sequence) -> DataFrame:
    """First ``n`` rows in key order (``TakeOrderedAndProject``); short input is fine."""
    return df.orderBy(*order_cols).limit(n)


def capped_sample(df: DataFrame, n: int, seed: int, row_id: str = "row_id", parts: Sequence[str] = ()) -> DataFrame:
    """Shuffle, then at most ``n`` rows."""
    return shuffle_rows(df, seed, row_id, parts).limit(n)


def sample_one(df: DataFrame, seed: int, row_id: str = "row_id") -> DataFrame:
    return capped_sample(df, 1, seed, row_id)


def hash_rank(df: DataFrame, hex_key: Column, tiebreak: Sequence[str] = (), rank_col: str = "rank",
              digits: int = BUCKET_DIGITS, total_col: Optional[str] = None) -> DataFrame:
    """0-based dense rank of rows ordered by a uniform hex key (then ``tiebreak``).

    Buckets are the first ``digits`` hex digits of the key (uniform, so no
    skew); their sizes (at most 16^digits rows, a proven bound) are prefix-
    summed and broadcast back; ``row_number`` runs within each bucket.
    ``total_col`` also attaches the total row count, with no extra action.
    """
    keyed = df.withColumn("_hk", hex_key).withColumn("_b", F.conv(F.substring("_hk", 1, digits), 16, 10).cast("int"))
    sizes = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.col("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")]
    if total_col:
        cols.append(F.sum("_n").over(Window.partitionBy()).alias(total_col))
    offsets = sizes.select(*cols)
    w = Window.partitionBy("_b").orderBy("_hk", *tiebreak)
    ranked = keyed.join(F.broadcast(offsets), "_b").withColumn(
        rank_col, (F.col("_base") + F.row_number().over(w) - 1).cast("long"))
    return ranked.drop("_hk", "_b", "_base")


def ordered_rank(df: DataFrame, order_cols: Sequence, rank_col: str = "rank",
                 partitions: Optional[int] = None) -> DataFrame:
    """0-based dense rank by arbitrary key columns (unique keys expected).

    Rows are range-partitioned by the key once: the bounds come from a sample
    that every reader of the plan would draw anew, so the partitioned rows are
    written (``checkpoint()``) with their partition's number before the sizes
    and the ranks are taken from them. The table of sizes has one row a
    partition.
    """
    from revisio.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = df.repartitionByRange(n, *order_cols).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    sizes = p.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    w = Window.partitionBy("_pid").orderBy(*order_cols)
    ranked = p.join(F.broadcast(offsets), "_pid").withColumn(
        rank_col, (F.col("_base") + F.row_number().over(w) - 1).cast("long"))
    return ranked.drop("_pid", "_base")


def global_rank(df: DataFrame, order_cols: Sequence[str] = (), hex_key: Optional[Column] = None,
                rank_col: str = "rank") -> DataFrame:
    if hex_key is not None:
        return hash_rank(df, hex_key, order_cols, rank_col)
    return ordered_rank(df, order_cols, rank_col)


def _at_or_after(cols: Sequence[str], key: Sequence, strict: bool) -> Column:
    """Rows whose key is at or after (``strict``: after) ``key`` in ascending
    order, nulls first: comparisons of columns with values, which a file scan
    can use."""
    c, v = F.col(cols[0]), key[0]
    later = c.isNotNull() if v is None else c > F.lit(v)
    same = c.isNull() if v is None else c == F.lit(v)
    if len(cols) == 1:
        if not strict:
            return F.lit(True) if v is None else c >= F.lit(v)
        return later
    first = F.lit(True) if v is None else c >= F.lit(v)  # alone, a bound that every file format can push
    return first & (later | (same & _at_or_after(cols[1:], key[1:], strict)))


def _at_or_before(cols: Sequence[str], key: Sequence, strict: bool) -> Column:
    c, v = F.col(cols[0]), key[0]
    earlier = F.lit(False) if v is None else c.isNull() | (c < F.lit(v))
    same = c.isNull() if v is None else c == F.lit(v)
    if len(cols) == 1:
        if strict:
            return earlier
        return same if v is None else c.isNull() | (c <= F.lit(v))
    first = same if v is None else c.isNull() | (c <= F.lit(v))
    return first & (earlier | (same & _at_or_before(cols[1:], key[1:], strict)))


def _at(cols: Sequence[str], key: Sequence) -> Column:
    return _at_or_after(cols, key, False) & _at_or_before(cols, key, False)


def _keys_at(keys: DataFrame, cols: Sequence[str], places: Sequence[int], small: int = SMALL) -> list[tuple]:
    """For each place in key order: (the key there, keys before the first equal
    one). Keys are dealt into ranges and counted, and the range that holds the
    place is dealt again until ``small`` keys are left, which are sorted."""
    def search(rows: DataFrame, n: int, before: int, wanted: list[int]) -> dict[int, tuple]:
        deals = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        parts, sizes = None, []
        if n > small:
            parts = written(rows.select(*cols).repartitionByRange(deals, *cols).withColumn("_pid", F.spark_partition_id()), "ranges")
            sizes = sorted((r["_pid"], r["n"]) for r in parts.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())
        if len(sizes) < 2:  # few keys, or keys that no range tells apart
            out = {}
            if parts is not None:
                removed(parts)
            for w in wanted:
                row = rows.select(*cols).orderBy(*cols).offset(w - before).limit(1).first()
                out[w] = (tuple(row), before + rows.filter(_at_or_before(cols, tuple(row), strict=True)).count())
            return out
        out, low = {}, before
        for pid, size in sizes:
            inside = [w for w in wanted if low <= w < low + size]
            if inside:
                out.update(search(parts.filter(F.col("_pid") == pid), size, low, inside))
            low += size
        removed(parts)
        return out

    found = search(keys, keys.count(), 0, sorted(set(places))) if places else {}
    return [found[p] for p in places]


def slice_rows(df: DataFrame, start: int, stop: Optional[int], order_cols: Sequence[str], rank: bool = True,
               small: int = SMALL) -> DataFrame:
    """Rows ``[start, stop)`` in ascending key order (nulls first) with their
    ``rank``; ``stop`` is clamped to the length.

    Only the key columns are read, written and counted to find the first and the
    last key; the rows are then taken by a range predicate on their columns,
    which reaches the scan. Of rows with equal keys at a bound, any are taken.
    """
    cols = list(order_cols)
    start = max(0, start)
    keys = written(df.select(*cols), "keys")
    n = keys.count()
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        out = df.filter(F.lit(False))
        return out.withColumn("rank", F.lit(0).cast("long")) if rank else out
    if (start, stop) == (0, n):
        out = df
    else:
        out, edges = df, []
        bounds = dict(zip((start, stop - 1), _keys_at(keys, cols, [start, stop - 1], small)))
        (low, before_low), (high, before_high) = bounds[start], bounds[stop - 1]
        ties = [keys.filter(_at(cols, k)).count() for k in (low, high)]
        whole_low, whole_high = before_low == start, before_high + ties[1] == stop
        if low == high and not (whole_low and whole_high):
            out = df.filter(_at(cols, low)).limit(stop - start)
        else:
            out = df.filter((_at_or_after(cols, low, not whole_low)) & _at_or_before(cols, high, not whole_high))
            for key, whole, take in ((low, whole_low, before_low + ties[0] - start), (high, whole_high, stop - before_high)):
                if not whole:
                    edges.append(df.filter(_at(cols, key)).limit(take))
        for e in edges:
            out = out.unionByName(e)
    removed(keys)
    if not rank:
        return out
    if stop - start <= small:
        place = F.row_number().over(Window.orderBy(*cols)) - 1  # at most ``small`` rows
        return out.withColumn("rank", (place + F.lit(start)).cast("long"))
    return ordered_rank(out, cols).withColumn("rank", F.col("rank") + F.lit(start))


def train_fraction(df: DataFrame, fraction: float, seed: int, row_id: str = "row_id",
                   exact: bool = True) -> DataFrame:
    """Exact-size random subset of ``floor(fraction * n)`` rows (the rest is
    discarded). ``exact=False`` keeps rows whose hash falls under the fraction
    instead: no count, no rank, about the same size."""
    key = h(seed, "split", F.col(row_id), "tr")
    if not exact:
        return df.filter(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") < int(fraction * (1 << 32)))
    return first_by_hash(df, key, (row_id,), lambda total: math.floor(float(fraction) * total))


def hash_top_k(df: DataFrame, hex_key: str, tiebreak: Sequence[str], k: int) -> DataFrame:
    """The ``k`` rows with the smallest uniform hex key, exactly (see
    ``first_by_hash``).

    ``orderBy().limit(k)`` would send every task's local top ``k`` to one
    reducer (tasks x k rows)."""
    return first_by_hash(df, F.col(hex_key), tiebreak, lambda total: k)


def _band(lo: int, hi: int, share: float, n: int) -> tuple[int, int]:
    """The part of ``[lo, hi)`` in which the key at ``share`` of ``n`` uniform keys lies, but for one case in a billion."""
    half = (hi - lo) * (6 * math.sqrt(share * (1 - share) / n) + 2 / n) + 1
    middle = lo + (hi - lo) * share
    return max(lo, math.floor(middle - half)), min(hi, math.ceil(middle + half))


def _kth(keys: DataFrame, n: int, k: int, order: Sequence[str], small: int, band: Callable = _band):
    """The ``k``-th of ``n`` keys (``_u``, the first 32 bits, and ``order``).

    The hashes are uniform, so the key's neighbourhood is known beforehand: each
    step counts the keys below a narrow band and those inside it, and goes on in
    the band, or beside it if the key was missed, until ``small`` keys are left.
    Bands that do not narrow are halved."""
    lo, hi, below, inside, step = 0, 1 << 32, 0, n, 0
    while inside > small and hi - lo > 1:
        a, b = band(lo, hi, (k - below) / inside, inside)
        step += 1
        if step > 8 or not lo <= a < b <= hi or (a, b) == (lo, hi):
            a, b = lo, lo + (hi - lo) // 2
        u = F.col("_u")
        left, here = keys.filter((u >= lo) & (u < b)).agg(F.count_if(u < a), F.count_if(u >= a)).first()
        if k <= below + left:
            hi, inside = a, left
        elif k <= below + left + here:
            lo, hi, below, inside = a, b, below + left, here
        else:
            lo, below, inside = b, below + left + here, inside - left - here
    rest = keys.filter((F.col("_u") >= lo) & (F.col("_u") < hi)).select(*order)
    return rest.orderBy(*order).offset(k - below - 1).limit(1).first()


def first_by_hash(df: DataFrame, hex_key: Column, tiebreak: Sequence[str], wanted: Callable[[int], int], small: int = SMALL,
                  band: Callable = _band) -> DataFrame:
    """The first ``wanted(total)`` rows by (uniform hex key, tiebreak), for unique keys.

    The plan of ``df`` is run once for a narrow table of its keys, and once more
    by whoever reads the result: the last wanted key is found on the table
    (``_kth``), and every row is compared with it where it stands. Whole rows are
    never shuffled, and nothing is joined."""
    keyed = df.withColumn("_hk", hex_key)
    order = ["_hk", *tiebreak]
    keys = written(keyed.select(F.conv(F.substring("_hk", 1, 8), 16, 10).cast("bigint").alias("_u"), *order), "keys")
    n = keys.count()
    k = min(wanted(n), n)
    if k >= n:
        out = df
    elif k <= 0:
        out = df.filter(F.lit(False))
    else:
        last = _kth(keys, n, k, order, small, band)
        types = {f.name: f.dataType for f in keys.schema.fields}
        bound = F.struct(*[F.lit(last[c]).cast(types[c]).alias(c) for c in order])
        out = keyed.filter(F.struct(*order) <= bound).select(*df.columns)
    removed(keys)
    return out
