"""Connected components of a graph of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the smallest node.

    Each round sends every node to its smallest neighbour and rewrites the links between the nodes
    that remain. Crowds and trees of small depth end within a few rounds; a path of n nodes in
    ascending order takes about n rounds, for each moves its links by one node only. A minimum is
    merged by partial aggregation and the joins are plain equi joins, so a node with very many links
    is split by adaptive execution. Each round is written to the shared folder; the driver only sees
    whether any link is left.
    """
    ends = cut(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while not ends.isEmpty():
        near = ends.select(F.explode(F.array(
            F.struct(F.col("a").alias("node"), F.col("a").alias("near")),
            F.struct(F.col("b").alias("node"), F.col("a").alias("near")),
        )).alias("x")).select("x.*")
        step = cut(near.groupBy("node").agg(F.min("near").alias("root")))
        steps.append(step)
        of_a = step.withColumnsRenamed({"node": "a", "root": "ra"})
        of_b = step.withColumnsRenamed({"node": "b", "root": "rb"})
        moved = ends.join(of_a, "a").join(of_b, "b").filter("ra <> rb")
        ends = cut(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not steps:
        return ends.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[0]
    for step in steps[1:]:
        further = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = found.join(further, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return cut(found)
