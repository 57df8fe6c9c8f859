"""4. Token ids as Parquet list columns.

Format: one folder of Parquet files ``doc_id long, ids array<int>, n_tokens
int``, written by Spark's own writer in ascending doc_id order over and within
the files. Ids are dictionary encoded while a column chunk's dictionary fits a
page, and fall back to delta encoding (format version 2). Row groups and pages
have set sizes, and each file holds column and offset indexes, so that a reader
that filters on doc_id touches a few pages, and one that selects only
``doc_id, n_tokens`` reads no ids at all.

Cases: null text is empty and holds the end id alone; rows with the same doc_id
are ordered by their ids' checksum and length (equal rows are alike either way);
a null doc_id comes first; an empty table gives an empty file set.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revisio.llm.common import arrow_rows, new_folder, on_workers, read_table
from revisio.llm.units import ByteLists, blocks, encoder

#: Bytes of a row group (before compression) and of a data page.
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
#: Bytes of text for a file: at about 1.2 stored bytes for each byte of text.
FILE_CHARS = 32 << 20
#: Texts that are encoded at once: the more, the fewer look-ups of their words.
BLOCK_ROWS, BLOCK_CHARS = 1000, 4_000_000

TOKENS = "doc_id long, ids array<int>, n_tokens int"


def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """``doc_id, ids, n_tokens`` for each row; ``end_id`` closes each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ByteLists, tokenizer_path)
        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            for a, b in blocks(column, BLOCK_ROWS, BLOCK_CHARS):
                ids = enc.lists(column.slice(a, b - a), end_id)
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), ids, pc.list_value_length(ids)], ["doc_id", "ids", "n_tokens"])

    on_workers(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, TOKENS)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0,
                 row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES,
                 file_chars: int = FILE_CHARS) -> None:
    """Encode ``docs`` (doc_id, text) into ``path``.

    The texts are dealt by ranges of (doc_id, crc of the text), then encoded,
    so that ids are never shuffled (they are larger than the text) and nothing
    is encoded twice for the sampling of the ranges. The number of files
    follows the bytes of text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-int(total) // file_chars), spark.sparkContext.defaultParallelism)
    order = [F.col("doc_id").asc_nulls_first(), F.crc32(F.coalesce("text", F.lit("")).cast("binary")), F.octet_length("text")]
    dealt = docs.repartitionByRange(files, *order).sortWithinPartitions(*order)
    with arrow_rows(spark, BLOCK_ROWS):
        token_ids(dealt, tokenizer_path, end_id).write \
            .option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes) \
            .option("parquet.dictionary.page.size", page_bytes).option("parquet.writer.version", "v2") \
            .option("parquet.enable.dictionary", "true").option("compression", "snappy") \
            .option("maxRecordsPerFile", 0).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "ids", "n_tokens")) -> DataFrame:
    """The given columns; a filter on doc_id prunes by page indexes."""
    return spark.read.schema(TOKENS).parquet(path).select(*columns)


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files.

    ``start`` counts all ids before a document over the whole set: files are
    ranges in order, so it is the sum of the earlier files (a table with a row
    for each file) and a running sum inside the file.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            flat, at = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False).view(np.uint8), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[4 * a:4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())],
                ["file", "row", "doc_id", "n_tokens", "ids_crc32"])

    on_workers(spark)
    tokens = spark.read.schema(TOKENS).parquet(path)
    rows = tokens.select(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int").alias("file"),
                         F.col("_metadata.row_index").alias("row"), "doc_id", "ids") \
        .mapInArrow(run, "file int, row long, doc_id long, n_tokens long, ids_crc32 long")
    # The lengths alone give the sums of files: no ids are read for it.
    sums = tokens.groupBy(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int").alias("file")) \
        .agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(base, "file").select(
        "doc_id", (F.col("_base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).cast("long").alias("start"),
        "n_tokens", "ids_crc32")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_folder(spark, "tokens")
    write_tokens(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_digest(spark, path)
