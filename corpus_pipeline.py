"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor
kept, and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revisio.llm.common import crc32_mod, new_folder, read_table, written
from revisio.llm.decontamination import remove_contaminated
from revisio.llm.jaccard import keep_one
from revisio.llm.packing import harmonic_packing
from revisio.llm.quality_knn import keep_good
from revisio.llm.quality_knn import learn as learn_knn
from revisio.llm.quality_rules import judged_rows, kept_rows, learn_rules

#: Near duplicates: word shingles of this size, and a similarity in percent.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rule or a learned rule rejects.

    The statistics are computed once and written beside the texts; learning
    reads the narrow columns alone, so no text is shuffled.
    """
    judged = written(judged_rows(docs), "pipeline-stats")
    return kept_rows(judged, learn_rules(judged.select("doc.doc_id", "_stats"), read_table(spark, sf_dir, "labels")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the nearest-neighbour vote scores below its threshold.

    The vote learns from the raw documents: their rejected part was what the
    labels call low.
    """
    labels = read_table(spark, sf_dir, "labels")
    return keep_good(docs, learn_knn(read_table(spark, sf_dir, "documents"), labels.filter(crc32_mod(F.col("doc_id"), 5) != 0)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return keep_one(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark passages."""
    return remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenize and pack what is left."""
    import public_tokenizers

    return harmonic_packing(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: Tokenizers, learned models and components are beyond SQL; the pipeline is
#: tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
