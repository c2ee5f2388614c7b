"""Connected components over a table of links, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.llm.common import stash


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Link every neighbour of a node to the smallest node of its neighbourhood:
    the neighbours above it (``larger``) or those below it and itself."""
    if larger:
        seen = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        seen = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = seen.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    linked = seen.join(low, "a")
    if larger:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
    return out.where("a != b").distinct()


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """``links`` (a long, b long) -> (node, root): the smallest node reachable.

    Alternating stars: the number of rounds grows with the logarithm of the
    longest path.  A hub is only ever aggregated (partial minimum) or joined,
    never gathered into a list.  Nodes without a link do not appear.
    """
    current = stash(links.where("a != b").select("a", "b").distinct(), name)
    mark = None
    while True:
        current = stash(_star(_star(current, True), False), name)
        row = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == mark:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark = (row.n, row.h)
