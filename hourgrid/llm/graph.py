"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one or two aggregations and joins by node; no node's neighbours are gathered. The tables of a
round are written to the shared folder, so lineage stays short and a lost executor repeats one step at most.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.llm import storage


def _point(pairs: DataFrame, strictly: bool) -> DataFrame:
    """Link the larger (`strictly`) or the smaller neighbours of each node to its least neighbour."""
    both = pairs.union(pairs.select("b", "a")) if strictly else pairs
    least = both.groupBy("a").agg(F.min("b").alias("low"))
    least = least.select("a", F.least("a", "low").alias("low"))
    joined = both.join(least, "a")
    if strictly:
        return joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
    kept = joined.select(F.col("b").alias("a"), F.col("low").alias("b"))
    return kept.union(least.select("a", F.col("low").alias("b"))).filter("a <> b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, component): every node of `pairs` (a, b) but each component's least node, with that node.

    Nulls are ignored.
    """
    ordered = pairs.filter("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = storage.staged(ordered, "edges")
    before = None
    while True:
        # Each row leads from a node to a smaller one. Once every node has one row, and every one of them
        # leads to a node without a row, the rows are stars.
        now = storage.staged(_point(_point(now, True), False), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
