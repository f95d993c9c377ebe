"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, staged


def contracted(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round over links (a, b: long, a < b): where each of their nodes points (node, to), and the links that are left.

    Each node points to its smallest neighbour or itself, chains of pointers
    are shortened twice, and links are carried over to what their ends point to.
    """
    both = rest.union(rest.select("b", "a"))
    points = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).withColumn("to", F.least("node", "to")), "points")
    for _ in range(2):
        moving = points.filter("node <> to").select(F.col("node").alias("to"), F.col("to").alias("next"))
        points = staged(spread_join(points, moving, "to", "node").select("node", F.coalesce("next", "to").alias("to")), "points")
    moving = points.filter("node <> to")
    left, right = moving.select(F.col("node").alias("a"), F.col("to").alias("a2")), moving.select(F.col("node").alias("b"), F.col("to").alias("b2"))
    one = staged(spread_join(rest, left, "a", "b").select(F.coalesce("a2", "a").alias("a2"), "b"), "links")
    two = spread_join(one, right, "b", "a2").select("a2", F.coalesce("b2", "b").alias("b2")).filter("a2 <> b2")
    return points, staged(two.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of each node of ``links`` (a, b: long); the root is the smallest node of the component.

    Rounds work on hashes of the nodes (a bijection of 64 bits), so that the
    order of the numbers makes no long chains: of the nodes that still have
    links about a third are left after a round.  Tables are written between
    rounds; whether links are left, and the few nodes with very many of them,
    come to the driver.
    """
    apart = staged(links.filter("a <> b").select("a", "b"), "links")
    nodes = staged(apart.select(F.col("a").alias("node")).union(apart.select("b")).distinct().withColumn("root", F.xxhash64("node")), "labels")
    hashed = apart.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    rest = staged(hashed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while not rest.isEmpty():
        points, rest = contracted(rest)
        onward = points.filter("node <> to").select(F.col("node").alias("root"), F.col("to").alias("next"))
        nodes = staged(spread_join(nodes, onward, "root", "node").select("node", F.coalesce("next", "root").alias("root")), "labels")
    least = nodes.groupBy("root").agg(F.min("node").alias("least"))
    return staged(spread_join(nodes, least, "root", "node").select("node", F.col("least").alias("root")), "labels")
