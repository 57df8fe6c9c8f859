"""6. Harmonic packing into sequences of at most ``capacity`` tokens.

Class i holds the pieces of which i fit a sequence: capacity/(i+1) < length <=
capacity/i. Each sequence of class i is filled with exactly i pieces, so a
worker fills the sequences of its classes without looking at any other.

A document is cut into whole sequences first. While its rest lies in a class
below ``whole_from`` and does not fill its class exactly, it gives off a piece
of the next class's exact size (capacity // (i+1)); from ``whole_from`` on the
rest stays whole, where a sequence loses at most 1/(whole_from+1). The pieces
that do not fill the last sequence of their class, fewer than i a class and so
bounded by the capacity alone, are packed first-fit by falling length.

Cases: null text is empty and is packed as its end id; rows with the same
doc_id are packed one by one; an empty table gives an empty result; a document
of any length is cut, never truncated.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revisio.llm.common import on_workers, read_table, written
from revisio.llm.units import WordUnits, blocks, encoder

CAPACITY = 4096
WHOLE_FROM = 16
#: Pieces of one class that one worker ranks: more of them are dealt to more workers.
BUCKET_ROWS = 20_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


def cut_lengths(n: int, capacity: int = CAPACITY, whole_from: int = WHOLE_FROM) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens, in order."""
    out, rest = [capacity] * (n // capacity), n % capacity
    while rest:
        fit = capacity // rest
        if fit >= whole_from or rest == capacity // fit:
            out.append(rest)
            break
        out.append(capacity // (fit + 1))
        rest -= capacity // (fit + 1)
    return out


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY,
           whole_from: int = WHOLE_FROM) -> DataFrame:
    """Tokenize and cut: one row for each piece."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(WordUnits, tokenizer_path)
        for batch in batches:
            keys, column = batch.column(0).to_pylist(), batch.column(1)
            for a, b in blocks(column):
                rows: list[tuple] = []
                for key, ids in zip(keys[a:b], enc.encode(column.slice(a, b - a).to_pylist())):
                    ids, at = ids + end, 0
                    n = len(ids) // 4
                    for size in cut_lengths(n, capacity, whole_from):
                        rows.append((key, at, size, zlib.crc32(ids[4 * at:4 * (at + size)]), n))
                        at += size
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                                 ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    on_workers(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, PIECES)


def pack(cut: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Give each piece its sequence and offset. ``cut`` is read more than once:
    pass a written table."""
    names = [f.split()[0] for f in PIECES.split(", ")]
    cut = cut.select(*names, F.expr(f"int({capacity} div length)").alias("_fit"))
    buckets = max(1, -(-cut.count() // bucket_rows))
    cut = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    # Where each (class, bucket) begins in its class: as many rows as classes times buckets.
    sizes = cut.groupBy("_fit", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_fit").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_fit", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    # Sequences that each class fills: one row a class, fewer than 2 * sqrt(capacity) + 1 classes.
    full = sizes.groupBy("_fit").agg(F.expr("sum(_n) div _fit").alias("_full"))
    lower = Window.orderBy("_fit").rowsBetween(Window.unboundedPreceding, -1)
    classes = full.select("_fit", "_full", F.coalesce(F.sum("_full").over(lower), F.lit(0)).alias("_base"),
                          F.sum("_full").over(Window.partitionBy()).alias("_sequences"))
    own = Window.partitionBy("_fit", "_bucket").orderBy("doc_id", "start", "length", "ids_crc32")
    placed = cut.join(starts, ["_fit", "_bucket"]) \
        .withColumn("_rank", F.col("_first") + F.row_number().over(own) - 1) \
        .join(F.broadcast(classes), "_fit") \
        .withColumn("_bin", F.expr("_rank div _fit"))
    placed = written(placed.select(*names, "_rank", F.when(F.col("_bin") < F.col("_full"), F.col("_base") + F.col("_bin"))
                                   .alias("sequence_id"), "_sequences"), "ranked")
    before = Window.partitionBy("sequence_id").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    filled = placed.filter("sequence_id is not null") \
        .select(*names, "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))

    def first_fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        room, bins, offsets = [], [], []
        for n in group["length"]:
            k = next((k for k, r in enumerate(room) if r >= n), len(room))
            if k == len(room):
                room.append(capacity)
            bins.append(k)
            offsets.append(capacity - room[k])
            room[k] -= n
        out = group[names].copy()
        out["sequence_id"] = group["_sequences"].to_numpy() + np.asarray(bins, dtype=np.int64)
        out["offset"] = np.asarray(offsets, dtype=np.int64)
        return out

    # Fewer than i pieces of each class i: a bound that does not grow with the documents.
    # (The id travels as text: pandas would turn a column with nulls into floats.)
    rest = placed.filter("sequence_id is null").withColumn("doc_id", F.col("doc_id").cast("string")) \
        .groupBy(F.lit(0).alias("_all")).applyInPandas(first_fit, PACKED.replace("doc_id long", "doc_id string"))
    return filled.unionByName(rest.withColumn("doc_id", F.col("doc_id").cast("long")))


def harmonic_packing(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY,
                     whole_from: int = WHOLE_FROM) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` for
    each piece. The texts are tokenized once; the pieces (about 50 bytes each)
    are written to the shared folder and ranked from there."""
    return pack(written(pieces(docs, tokenizer_path, end_id, capacity, whole_from), "pieces"), capacity)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return harmonic_packing(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
