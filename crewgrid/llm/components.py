"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the node; a node with very many edges is only ever summarised by its minimum
(combined before the shuffle) or joined against one row, which adaptive execution splits.  Each round is written once to the
shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewgrid.llm import textops as X


def _star(edges):
    """Links every neighbour of a node, and the node, to the least of them."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).union(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
    least = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("low"))
    return both.join(least, "n"), least


def _settled(edges):
    """Whether every node hangs on one other that hangs on none."""
    ends = edges.select(F.col("v").alias("n"), F.lit(1).alias("up")).union(edges.select(F.col("u").alias("n"), F.lit(0).alias("up")))
    return ends.groupBy("n").agg(F.sum("up").alias("ups"), F.min("up").alias("top")).where("ups > 1 OR ups = 1 AND top = 0").isEmpty()


def components(spark, edges):
    """(id, label) for each node of edges(u, v); label is the component's least node."""
    now = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    now = X.written(spark, now, "edges")
    while not _settled(now):
        both, _ = _star(now)
        large = both.where("m > n").select(F.col("low").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.groupBy("v").agg(F.min("u").alias("low"))
        small = large.join(down, "v")
        new = small.where("u <> low").select(F.col("low").alias("u"), F.col("u").alias("v")).union(down.select(F.col("low").alias("u"), "v")).distinct()
        now = X.written(spark, new, "edges")
    return now.select(F.col("v").alias("id"), F.col("u").alias("label")).union(now.select(F.col("u").alias("id"), F.col("u").alias("label")).distinct())
