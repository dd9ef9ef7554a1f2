"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.session import materialize


def component_labels(edges: DataFrame, scope: list[str], a: str, b: str) -> DataFrame:
    """(scope, node, component) for an undirected edge list, one graph per scope value.

    The component is its smallest node. In each step every node joins the first of itself and its
    neighbours in an order drawn anew, and edges are taken between the nodes that are left. That leaves
    a constant share of them whatever the shape of the graph, so steps grow with the logarithm of the
    nodes, long chains included, and tables shrink from step to step. Every step is written to the
    shared folder, so lineage stays short and a lost executor costs one step.
    """
    known = edges.select(*scope, F.col(a).alias("node"), F.col(b).alias("other")).dropna()
    links = materialize(known.select(
        *scope, F.least("node", "other").alias("node"), F.greatest("node", "other").alias("other")).distinct(), "links")
    ends = links.select(*scope, "node").union(links.select(*scope, "other"))
    nodes = [materialize(ends.distinct().withColumn("low", F.col("node")), "nodes")]
    links, moves = links.filter("node != other"), []
    while not links.isEmpty():
        def first(c, number=len(moves)):
            return F.struct(F.xxhash64(F.lit(number), c).alias("order"), F.col(c).alias("to"))
        both = links.unionByName(links.select(*scope, F.col("other").alias("node"), F.col("node").alias("other")))
        move = both.groupBy(*scope, "node").agg(F.min(first("other")).alias("_o")).select(
            *scope, "node", F.least(first("node"), "_o")["to"].alias("to"))
        move = materialize(move, "moves")
        moves.append(move)
        nodes.append(materialize(nodes[-1].join(move, [*scope, "node"]).groupBy(
            *scope, F.col("to").alias("node")).agg(F.min("low").alias("low")), "nodes"))
        there = move.select(*scope, F.col("node").alias("other"), F.col("to").alias("_other"))
        moved = links.join(move, [*scope, "node"]).select(*scope, "other", "to").join(there, [*scope, "other"])
        links = materialize(moved.filter(F.col("to") != F.col("_other")).select(
            *scope, F.least("to", "_other").alias("node"), F.greatest("to", "_other").alias("other")).distinct(), "links")
    labels = nodes[-1].select(*scope, "node", F.col("low").alias("component"))
    for here, move in zip(nodes[-2::-1], moves[::-1]):  # a node without links was complete
        joined = move.join(labels.withColumnRenamed("node", "to"), [*scope, "to"]).select(*scope, "node", "component")
        labels = materialize(here.join(joined, [*scope, "node"], "left").select(
            *scope, "node", F.coalesce("component", "low").alias("component")), "labels")
    return labels
