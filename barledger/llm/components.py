"""Connected components by repeated contraction, entirely as distributed joins.

In every round each node is merged into its smallest neighbour and the edges are
rewritten between what is left, so the smallest id of a component survives to the end.
Rounds shrink the graph; their tables are composed backwards into node -> component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barledger.llm.tables import published


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of comparable ids -> (node, component) for every node with an edge.

    Nulls, loops and repeated or reversed edges change nothing; no edges give no rows.
    """
    edges = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    edges = published(edges, "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("parent"))
        parent = published(parent, "parents")
        rounds.append(parent)
        edges = published(
            edges.join(parent.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a")
            .join(parent.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b")
            .where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
            "edges",
        )
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    root = rounds[-1].select("node", F.col("parent").alias("component"))
    for parent in reversed(rounds[:-1]):
        above = root.select(F.col("node").alias("parent"), F.col("component"))
        root = parent.join(above, "parent", "left").select("node", F.coalesce("component", "parent").alias("component"))
        root = published(root, "roots")
    return root
