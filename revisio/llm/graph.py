"""Connected components by contraction, as Spark joins."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisio.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (columns a, b): equal labels
    where nodes are connected.

    In each round every node takes the least of itself and its neighbours, and
    edges are drawn between what their ends have taken, until none is left.
    Nodes are expected to be hashes: their order is random then, and the number
    of rounds grows with the logarithm of a component's diameter. A round is
    joins and partial aggregates over narrow rows; its tables are written, so a
    lost executor repeats little, and a node with very many edges is split by
    the skew join (the table of parents has one row a node).
    """
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = edges.select(F.col("a").alias("node")).unionAll(edges.select("b")).distinct().withColumn("label", F.col("node"))
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")), "parents")
        # The labels follow every round's parents; this chain runs once, at the end.
        labels = labels.join(parent.select(F.col("a").alias("label"), "p"), "label", "left") \
            .select("node", F.coalesce("p", "label").alias("label"))
        one, two = parent.select("a", F.col("p").alias("pa")), parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        edges = written(edges.join(one, "a").join(two, "b").filter("pa <> pb")
                        .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    return written(labels, "labels")
