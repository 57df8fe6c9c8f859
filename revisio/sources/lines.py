"""Line numbers for text files without a key: line i of a set of files.

Files count in the order of their part numbers (then names), lines in the order
in which they stand. A reader may cut a large file into blocks; lines are
numbered inside a block where they are read, written once with their block, and
a small table of block sizes (a row a block, no text) moves each block to its
place. No window sees all lines, and no line is shuffled.
"""
from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revisio.operators.store import PLACE, bytes_of, can_put_aside, fetched, put_aside, tasks_for
from revisio.session import ensure_checkpoint_dir, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each line's place in its block; a block's lines come in a row, over as many batches as they take."""
    block, at = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        name = pc.dictionary_encode(batch.column(1)).indices.to_numpy(zero_copy_only=False)
        start = batch.column(2).to_numpy()
        first = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (start[1:] != start[:-1])]))
        place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        here = (batch.column(1)[0].as_py(), int(start[0]))
        if here == block:
            place[:first[1] if len(first) > 1 else n] += at
        block, at = (batch.column(1)[n - 1].as_py(), int(start[-1])), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], [*batch.schema.names, "at"])


def _file_order(path: str) -> tuple:
    name = path.rsplit("/", 1)[-1]
    part = re.match(r"part-(\d+)", name)
    return (int(part.group(1)) if part else -1, name, path)


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """``line`` (from 0 over all files of ``path``), ``value``. Empty lines count;
    the driver holds the size of each block."""
    return _numbered(spark, path, lambda placed: written(placed, "lines"))


def _numbered(spark: SparkSession, path, store: Callable) -> DataFrame:
    """``numbered_lines``, with the columns that ``store`` gives in place of ``value``."""
    ensure_checkpoint_dir(spark)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    placed = store(lines.mapInArrow(_places, "value string, file string, block long, at long"))
    sizes = [(r["file"], r["block"], r["n"]) for r in placed.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).collect()]
    offsets, before = [], 0
    for file, block, n in sorted(sizes, key=lambda s: (_file_order(s[0]), s[1])):
        offsets.append((file, block, before))
        before += n
    table = spark.createDataFrame(offsets, "file string, block long, before long")
    rest = [c for c in placed.columns if c not in ("file", "block", "at")]
    return placed.join(F.broadcast(table), ["file", "block"]).select((F.col("before") + F.col("at")).alias("line"), *rest)


def pair_lines(spark: SparkSession, predictions, references) -> DataFrame:
    """``line, prediction, reference``: line i of one set of files beside line i
    of the other. Sets of unequal length fail when the result is read. The lines
    are put aside once, and only their places meet."""
    names = ("prediction", "reference")
    if can_put_aside(spark):
        sides = [_numbered(spark, path, lambda placed: put_aside(placed, ["value"], "lines")) for path in (predictions, references)]
        tasks = tasks_for(sum(map(bytes_of, sides)))
        p, r = (side.select("line", *[F.col(c).alias(c + n) for c in PLACE]).repartition(tasks, "line") for side, n in zip(sides, names))
        markers = [F.col(PLACE[0] + n) for n in names]
    else:
        p, r = (numbered_lines(spark, path).select("line", F.col("value").alias(n), F.lit(True).alias(f"_{n}")) for path, n in zip((predictions, references), names))
        markers = [F.col(f"_{n}") for n in names]
    both = p.join(r, "line", "full_outer")
    checked = F.when(markers[0].isNotNull() & markers[1].isNotNull(), True) \
        .otherwise(F.raise_error(F.concat(F.lit("no partner for line "), F.col("line").cast("string"))).cast("boolean"))
    both = both.filter(checked)
    if can_put_aside(spark):
        for n in names:
            both = fetched(both, [n], [c + n for c in PLACE])
    return both.select("line", *names)
