"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import staged


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links of every node's neighbours (the larger ones, or the node and the smaller ones) to the smallest of all."""
    both = links.select(F.col("a").alias("n"), F.col("b").alias("m")).union(links.select(F.col("b").alias("n"), F.col("a").alias("m")))
    if not large:
        both = both.where("m < n")
    least = both.groupBy("n").agg(F.min("m").alias("least")).withColumn("least", F.least("least", "n"))
    # the smallest neighbour is written before the join, so a node with very many links is a partition that Spark can split
    out = both.join(staged(least), "n")
    out = out.where("m > n").select(F.col("least").alias("a"), F.col("m").alias("b")) if large else out.select(F.col("least").alias("a"), F.col("m").alias("b")).union(least.select(F.col("least").alias("a"), F.col("n").alias("b")))
    return out.where("a < b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node that each node of links (a, b) reaches. Nodes without links to others have no row.

    Each round writes its links to the shared folder; rounds grow with the logarithm of the number of nodes.
    """
    now = staged(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    mark = lambda df: df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
    seen = mark(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        now = staged(_star(staged(_star(now, True)), False))
        if (new := mark(now)) == seen:
            break
        seen = new
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
