"""Connected components of a graph whose edges are spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the same for connected nodes.

    Every node takes its smallest neighbour as parent, parents are followed to their ends by doubling, each tree
    becomes one node, and edges between trees go on to the next round. Trees at least halve, so rounds grow with
    the logarithm of the nodes. Joins read tables that were written, so hot trees can be split at run time."""
    spark = edges.sparkSession
    found = None
    rest = cut(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not rest.isEmpty():
        both = rest.union(rest.select("b", "a"))
        parent = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            above = cut(parent.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")))
            parent = above.select("node", "root")
            if above.where("moved").isEmpty():
                break
        if found is None:
            found = parent
        else:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            found = cut(found.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")))
        one = rest.join(parent.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        two = one.join(parent.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        rest = cut(two.where(F.col("ra") != F.col("rb")).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return spark.createDataFrame([], "node long, root long") if found is None else found
