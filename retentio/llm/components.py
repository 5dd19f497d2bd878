"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import settle


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is a component's smallest node.

    Each round hooks a node to its smallest neighbour, jumps once over that
    neighbour's own hook and contracts the links, so that their number falls
    by a factor and a chain of n nodes takes about log n rounds. Every round
    is written to the shared checkpoint folder; nothing is collected.
    """
    links = settle(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    nodes = links.select("a").union(links.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("root"))
    while not links.isEmpty():
        # the smallest neighbour is never above the node itself, so hooks make no cycles
        hook = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min(F.least("a", "b")).alias("p"))
        hook = settle(hook, "hooks")
        over = hook.select(F.col("a").alias("p"), F.col("p").alias("q"))
        jump = settle(hook.join(over, "p").select("a", "q"), "jumps")
        nodes = settle(nodes.join(jump, nodes["root"] == jump["a"], "left").select("node", F.coalesce("q", "root").alias("root")), "roots")
        left = links.join(jump, "a").select(F.col("q").alias("x"), "b")
        both = left.join(jump.select(F.col("a").alias("b"), F.col("q").alias("y")), "b").where("x <> y")
        links = settle(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return nodes
