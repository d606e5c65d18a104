"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being one node of its component.

    Each round hooks every node to the smallest of itself and its neighbours and contracts the graph to the hooks, until
    no edge is left. With node numbers in no order the graph shrinks by a constant factor a round; a star of any size goes in
    one. Hot nodes are aggregated before the shuffle. Each round's two tables are stored, so lineage stays short.
    """
    edges = cut(edges.select("a", "b").filter("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")))
        if labels is None:
            labels = hooks.select("node", F.col("up").alias("root"))
        else:
            labels = labels.join(hooks.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        labels = cut(labels)
        edges = (edges.join(hooks.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a")
                 .join(hooks.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
                 .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).filter("a <> b").distinct())
        edges = cut(edges)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
