"""Connected components of a table of links, as rounds of joins. No graph passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.llm.common import discard, saved


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the label is the smallest node that it can reach.

    Each round hooks every node to its smallest neighbour and contracts the links to those parents, until none are
    left. Rounds are written to the shared folder, so lost executors cost one round at most.
    """
    edges = saved(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = saved(nodes.select("node", F.col("node").alias("label")), "labels")
    while not edges.isEmpty():
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e"))
        parents = saved(ends.groupBy(F.col("e.x").alias("x")).agg(F.min("e.y").alias("y")).select("x", F.least("x", "y").alias("p")), "parents")
        pa, pb = parents.toDF("a", "pa"), parents.toDF("b", "pb")
        moved = edges.join(pa, "a").join(pb, "b").where("pa <> pb")
        next_edges = saved(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
        pl = parents.toDF("label", "p")
        next_labels = saved(labels.join(pl, "label", "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
        for old in (edges, labels, parents):
            discard(old)
        edges, labels = next_edges, next_labels
    discard(edges)
    return labels
