"""Generate examples from a stream of corpus rows.

Plain and masked pairs (random and difference masks) are row-local: column
expressions, one explode and one Arrow UDF, with no global state. They run
unchanged on a streaming DataFrame, micro-batch by micro-batch; each input
row's examples depend only on the row and the seed, so a replayed batch
(after a failure) produces identical rows and an idempotent sink stays
exact. Operators that need all rows (the no-edit cap, exact subsets,
shuffles, ranks, batching, metrics) are batch-only and are rejected here.
"""
from __future__ import annotations

from typing import List, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from revisio.operators.pairs import edit_pairs
from revisio.operators.projections import reverse_pair
from revisio.plans.recipes import Recipe


def stream_examples(rows: DataFrame, recipe: Recipe, catalogue: Mapping[str, List[str]], seed: int = 0) -> DataFrame:
    """``(row_id, variant, input, output, type, from)`` for each arriving row:
    the plain and masked pairs, in both directions where the recipe has two.
    The recipe's no-edit rows are left out: their cap is over all rows, so they
    belong to a batch run."""
    if recipe.fraction is not None or recipe.intent is not None:
        raise ValueError(f"recipe {recipe.key} needs all rows (subset or span generator); run it in batch")
    df = rows.filter(F.col("split").isin(list(recipe.splits)))
    if recipe.type_filter:
        col, val = recipe.type_filter
        df = df.filter(F.col(col) == F.lit(val))
    base = recipe.prepare(df).select("row_id", "input", "output")
    out = edit_pairs(base, catalogue[recipe.group], recipe.repeat, recipe.mask_sample_size, recipe.diff, seed,
                     f"{recipe.key}/fwd")
    out = out.withColumn("from", F.lit(recipe.tag))
    if recipe.reverse_group:
        back = edit_pairs(reverse_pair(base), catalogue[recipe.reverse_group], recipe.repeat, recipe.mask_sample_size, recipe.diff, seed,
                          f"{recipe.key}/rev")
        out = out.unionByName(back.withColumn("from", F.lit(recipe.reverse_tag)))
    return out


def stream_to_corpus(rows: DataFrame, recipe: Recipe, catalogue: Mapping[str, List[str]], path: str, checkpoint: str,
                     seed: int = 0) -> StreamingQuery:
    """Write the examples of all rows that have arrived to ``path``, partitioned
    as ``write_corpus`` does, and stop.

    ``checkpoint`` remembers which input has been read; a later start with the
    same folders goes on from there. The file sink lists a batch's files only
    once the whole batch is written, so a batch that is run again after a
    failure replaces what it wrote before and no example stands twice."""
    out = stream_examples(rows, recipe, catalogue, seed)
    return out.writeStream.format("parquet").outputMode("append").partitionBy("from", "type").option("path", path) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
