"""Connected components of a graph given by its edges, by alternating star contraction.

Each round joins every node's larger neighbours to the smallest node next to it, then its smaller ones, until the
edges stay the same; all steps are joins and minima (combined before the shuffle), so a node with very many edges is
split like any skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetrail.llm.common import landed


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node of its component) for each node of ``edges`` (a, b longs); nodes without an edge to
    another node aren't listed."""
    now = landed(edges.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(),
                 "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            now.select(F.col("m").alias("u"), "v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select("v", "m").distinct()
        low = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(low, "v")
        now = landed(small.where("m > low").select(F.col("m").alias("v"), F.col("low").alias("m"))
                     .unionByName(low.select("v", F.col("low").alias("m"))).distinct(), "edges")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    roots = now.select(F.col("m").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return now.groupBy(F.col("v").alias("node")).agg(F.min("m").alias("comp")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Stays the same where the edges do."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())
