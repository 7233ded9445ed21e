"""Connected components of a link table, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node links to the node's smallest neighbour instead."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "minima")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours link to the smallest of them."""
    least = written(links.groupBy("a").agg(F.min("b").alias("m")), "minima")
    moved = links.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that is not itself the smallest of its component; ``links`` has long columns a, b.

    Rounds of large star and small star end when a round changes nothing; each round is written to the shared folder,
    so the plan stays short and a lost executor costs one round at most. Partial aggregation finds the minima, which are
    written too: a hub's rows then meet its minimum in a join of their own that Spark may split, so no node's neighbours
    meet in one task.
    """
    now = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    mark = None
    while True:
        now = written(_small_star(_large_star(now).distinct()).distinct(), "links")
        last, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last or mark[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
