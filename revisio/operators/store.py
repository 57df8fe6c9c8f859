"""Texts put aside: written once, fetched by place.

A random order of examples moves every example to another task, and an example
repeats its row's texts. Instead of the texts, their place travels: each row's
texts are written once, as one compressed record, to files in the shared folder,
and whoever has the place of a record (file, start, size) reads it back there.
Records are read by plain file access, so the shared folder has to be a mounted
one (``can_put_aside``); elsewhere finished rows travel as before.
"""
from __future__ import annotations

import os
import sys
from collections import OrderedDict
from collections.abc import Iterator, Sequence
from struct import Struct
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revisio.session import removed, scratch_path, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Where a row's record lies, and the bytes of its texts.
PLACE = ["_file", "_start", "_size", "_bytes"]
#: Bytes of text that a task of a shuffle of places fetches behind it, about.
TASK_BYTES = 64 << 20
#: Bytes of texts that a task holds at once, but for a single larger record; files that it keeps open.
HELD, OPEN = 4 << 20, 256


def _folder(spark: SparkSession) -> str:
    """One folder an application: files are numbered by task attempts, which are unique in it."""
    return scratch_path(spark, f"revisio-records/{spark.sparkContext.applicationId}")


def can_put_aside(spark: SparkSession) -> bool:
    return urlparse(_folder(spark)).scheme in ("", "file")


def tasks_for(size: int) -> int:
    """Tasks for so many bytes of text: the planner sees only the places."""
    return max(1, -(-size // TASK_BYTES))


def bytes_of(aside: DataFrame) -> int:
    return int(aside.agg(F.sum("_bytes")).first()[0] or 0)


def _path(spark: SparkSession) -> str:
    folder = _folder(spark)
    return unquote(urlparse(folder).path) if folder.startswith("file:") else folder


def _record(texts: Sequence, head: Struct, codec: pa.Codec) -> tuple[bytes, int]:
    """The lengths of the texts (-1 for null) and the compressed texts; their bytes."""
    parts = [b"" if t is None else t for t in texts]
    whole = b"".join(parts)
    return head.pack(*[-1 if t is None else len(p) for t, p in zip(texts, parts)]) + codec.compress(whole, asbytes=True), len(whole)


def _texts(record: bytes, head: Struct, codec: pa.Codec) -> list:
    lengths = head.unpack_from(record)
    size = sum(n for n in lengths if n > 0)
    whole, at, out = codec.decompress(record[head.size:], size, asbytes=True), 0, []
    for n in lengths:
        out.append(None if n < 0 else whole[at:at + n])
        at += max(n, 0)
    return out


def put_aside(df: DataFrame, cols: Sequence[str], name: str = "aside") -> DataFrame:
    """Writes the texts ``cols`` of each row to record files; the other columns,
    with the place of the row's record, become a stored table."""
    folder, n_cols = _path(df.sparkSession), len(cols)
    rest = [f for f in df.schema.fields if f.name not in cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        number, at = TaskContext.get().taskAttemptId(), 0
        head, codec = Struct(f"<{n_cols}i"), pa.Codec("zstd", 3)
        with open(f"{folder}/{number}", "xb") as file:
            for batch in batches:
                starts, sizes, lengths = [], [], []
                texts = [batch.column(batch.schema.get_field_index(c)) for c in cols]
                for i in range(batch.num_rows):
                    record, n = _record([t[i].as_buffer() for t in texts], head, codec)
                    file.write(record)
                    starts.append(at)
                    sizes.append(len(record))
                    lengths.append(n)
                    at += len(record)
                kept = [batch.column(batch.schema.get_field_index(f.name)) for f in rest]
                place = [pa.array([number] * batch.num_rows, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(lengths, pa.int64())]
                yield pa.RecordBatch.from_arrays([*kept, *place], [*[f.name for f in rest], *PLACE])

    return written(df.mapInArrow(run, T.StructType([*rest, *[T.StructField(p, T.LongType()) for p in PLACE]])), name)


def fetched(df: DataFrame, cols: Sequence[str], place: Sequence[str] = PLACE) -> DataFrame:
    """The rows with the texts of their records as ``cols`` (null where a row has
    no place), in their order. ``place``: the columns of ``PLACE`` under other names."""
    folder, n_cols = _path(df.sparkSession), len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, codec, files = Struct(f"<{n_cols}i"), pa.Codec("zstd"), OrderedDict()

        def read(number: int, start: int, size: int) -> bytes:
            if number not in files:
                if len(files) >= OPEN:
                    os.close(files.popitem(last=False)[1])
                files[number] = os.open(f"{folder}/{number}", os.O_RDONLY)
            files.move_to_end(number)
            out = os.pread(files[number], size, start)
            if len(out) != size:
                raise OSError(f"record {start} of {folder}/{number} is cut off")
            return out

        try:
            for batch in batches:
                number, start, size, n = (batch.column(batch.schema.get_field_index(p)).to_pylist() for p in place)
                i = 0
                while i < batch.num_rows:
                    first, held, texts = i, 0, []
                    while i < batch.num_rows and (i == first or held + (n[i] or 0) <= HELD):
                        texts.append([None] * len(cols) if number[i] is None else _texts(read(number[i], start[i], size[i]), head, codec))
                        held += n[i] or 0
                        i += 1
                    columns = [pa.array(list(c), pa.binary()).view(pa.string()) for c in zip(*texts)]
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, i - first).columns, *columns], [*batch.schema.names, *cols])
        finally:
            for f in files.values():
                os.close(f)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(c, T.StringType()) for c in cols]]))


def dropped(aside: DataFrame) -> None:
    """Delete a table of ``put_aside`` and its records, which nothing reads any more."""
    folder = _path(aside.sparkSession)
    for row in aside.select("_file").distinct().collect():
        os.remove(f"{folder}/{row['_file']}")
    removed(aside)
