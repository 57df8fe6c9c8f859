"""Small helpers that the operators of this subpackage share."""
from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revisio.session import ensure_checkpoint_dir

# Fixed values of the contracts: ASCII letters for lower-casing, and the two
# word patterns (in Java and RE2 syntax alike).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster without a shared code folder, install the package or ship it
    with ``--py-files``; the path added here is then simply absent.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path under the cluster's shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(table: DataFrame) -> None:
    """Delete a table that ``written`` made, once nothing reads it any more."""
    jvm, conf = table.sparkSession._jvm, table.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {os.path.dirname(f) for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("llm-"):
            path.getFileSystem(conf).delete(path, True)


def crc32_mod(c: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``: the contracts' splits."""
    return F.crc32(c.cast("string").cast("binary")) % F.lit(n)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Rows in an Arrow batch while a job runs: fewer bound the memory that
    long texts take on both sides of a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
