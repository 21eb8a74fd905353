"""Connected components by alternating star contractions, as joins and minima only.

No node's neighbours are ever gathered: a star step joins each edge with the least
neighbour of its end, a minimum that is combined before the shuffle. The minima are dealt
anew before the join (the rebalance hint), so that both sides of it are plain exchanges
and the optimizer may split it where a node has very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import cut, slim


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Joins each neighbour that is greater than a node to the least of the node and its neighbours. Gives no more rows than edges; some may be equal."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = slim(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), n).hint("rebalance")
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Joins each node and its lesser neighbours to the least of them. Edges have u > v."""
    least = slim(edges.groupBy("u").agg(F.min("v").alias("m")), n).hint("rebalance")
    lesser = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return slim(lesser.union(least.select("u", F.col("m").alias("v"))), n).distinct()


def _are_stars(edges: DataFrame, n: int) -> bool:
    """Whether each u has one v, and no v is a u."""
    up = edges.select(F.col("u").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("root"))
    ends = up.union(edges.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("ups").alias("ups"), F.max("root").alias("root"))
    return slim(ends, n).agg(F.count_if(F.col("ups") + F.col("root") > 1)).first()[0] == 0


def roots(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of ``edges`` (u, v, of one ordered type), the least node it can reach.

    Loops and repeated edges do no harm. Each round is cut; it ends when the edges are
    stars, after a number of rounds that grows with the logarithm of the nodes. Stars given
    need none: ``stars`` of what is known and new edges need fewer than all edges anew.
    No round has more edges than the first, so their number sets the tasks.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct())
    n = now.count()
    now = slim(now, n)
    while not _are_stars(now, n):
        now = cut(slim(_small_star(slim(_large_star(now, n), n), n), n))
    lone = slim(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct(), n)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(lone)


def stars(linked: DataFrame) -> DataFrame:
    """u, v: edges that give the groups of ``linked`` (node, root) again."""
    return linked.where("node != root").select(F.col("node").alias("u"), F.col("root").alias("v"))
