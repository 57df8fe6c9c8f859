"""Batches over a seeded order. Positions come from the
bucketed global rank: no single-partition window."""
from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revisio.operators.order import hash_rank, shuffle_key
from revisio.operators.tokenize import attention_mask, pad_to_length

IGNORED = -100  # Fixed value: the label that a loss leaves out.


def ranked(df: DataFrame, seed: int, row_id: str = "row_id") -> DataFrame:
    """Adds ``rank`` (seeded random order) and ``n`` (row count)."""
    return hash_rank(df, shuffle_key(seed, row_id, stream="batch"), (row_id,), rank_col="rank", total_col="n")


def assign_batches(df: DataFrame, batch_size: int, seed: int, mode: str = "drop_last",
                   row_id: str = "row_id") -> DataFrame:
    """``drop_last``: ``n // bs`` full batches, remainder dropped;
    ``even``: ``ceil(n / bs)`` batches whose sizes differ by at most one,
    larger first; ``fixed``: batches of ``bs``, the last one short.
    Adds ``batch_id`` and ``pos_in_batch``, both by arithmetic on the rank."""
    r = ranked(df, seed, row_id)
    bs = F.lit(batch_size)
    rank = F.col("rank")
    if mode == "drop_last":
        out = r.filter(rank < F.floor(F.col("n") / bs) * bs).withColumns({"batch_id": F.floor(rank / bs), "pos_in_batch": rank % bs})
    elif mode == "fixed":
        out = r.withColumns({"batch_id": F.floor(rank / bs), "pos_in_batch": rank % bs})
    elif mode == "even":
        steps = F.ceil(F.col("n") / bs)
        q = F.floor(F.col("n") / steps)
        rem = F.col("n") - q * steps
        big = rem * (q + 1)
        out = r.withColumns({
            "batch_id": F.when(rank < big, F.floor(rank / (q + 1))).otherwise(rem + F.floor((rank - big) / q)),
            "pos_in_batch": F.when(rank < big, rank % (q + 1)).otherwise((rank - big) % q)})
    else:
        raise ValueError(mode)
    return out.withColumns({"batch_id": F.col("batch_id").cast("long"), "pos_in_batch": F.col("pos_in_batch").cast("int")}).drop("n")


def batch_max_length(df: DataFrame, ids_col: str, multiple: Optional[int] = None, out: str = "pad_len") -> DataFrame:
    """Length every row of a batch is padded to: the longest row of the
    batch, rounded up to ``multiple`` (8 for half precision)."""
    return df.withColumn(out, _longest(ids_col, multiple))


def _longest(ids_col: str, multiple: Optional[int]):
    m = F.max(F.size(ids_col)).over(Window.partitionBy("batch_id"))
    if multiple:
        m = F.ceil(m / F.lit(multiple)) * F.lit(multiple)
    return m.cast("int")


def pad_batches(df: DataFrame, multiple: Optional[int] = None) -> DataFrame:
    """Pad ``input_ids`` with the pad id and ``labels`` with -100, each to its
    longest row in the batch; adds ``attention_mask``, ``pad_len`` and
    ``label_len``. One window by batch serves both."""
    df = df.withColumns({"pad_len": _longest("input_ids", multiple), "label_len": _longest("labels", multiple)})
    return df.withColumns({"attention_mask": attention_mask(F.col("input_ids"), F.col("pad_len")),
                           "input_ids": pad_to_length(F.col("input_ids"), F.col("pad_len")),
                           "labels": pad_to_length(F.col("labels"), F.col("label_len"), IGNORED)})


def batch_plan(df: DataFrame, batch_size: int, epochs: int = 1, devices: int = 1, accumulation: int = 1,
               drop_last: bool = True) -> DataFrame:
    """Examples, steps per epoch, total steps, total batch size."""
    total_bs = batch_size * devices * accumulation
    n = F.count(F.lit(1))
    steps = F.floor(n / F.lit(total_bs)) if drop_last else F.ceil(n / F.lit(total_bs))
    return df.agg(n.alias("examples"), steps.cast("long").alias("steps_per_epoch"),
                  (steps * F.lit(epochs)).cast("long").alias("total_steps"),
                  F.lit(total_bs).alias("total_batch_size"))


def collate(df: DataFrame, cols) -> DataFrame:
    """One row per batch with the rows' values in batch order (a batch is
    at most ``batch_size`` rows)."""
    entries = F.array_sort(F.collect_list(F.struct("pos_in_batch", *cols)))
    return df.groupBy("batch_id").agg(entries.alias("_rows")).select(
        "batch_id", *[F.transform("_rows", _field(c)).alias(c) for c in cols])


def _field(c: str):
    return lambda s: s[c]
