"""Connected components of a table of links, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.session import stage


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours that are larger (or not) are linked to the smallest of the node and its neighbours.

    The smallest neighbours are written first: both sides of the join then are plain scans, and adaptive
    execution splits the node that most links share.
    """
    if large:
        around = edges.union(edges.select("b", "a")).toDF("u", "v")
    else:
        around = edges.toDF("u", "v")  # the first is the larger one
    centre = stage(around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    joined = around.join(centre, "u")
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            centre.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b); the root is the smallest node of the component.

    The rounds needed grow with the logarithm of the longest chain. Each round is written to the shared folder and read
    again; only a count and a checksum come to the driver. Null ends and loops are left out.
    """
    edges = stage(links.toDF("a", "b").where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _checksum(edges)
    while before[0]:
        edges = stage(_star(stage(_star(edges, large=True)), large=False))
        after = _checksum(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(edges.select("b", "b").distinct().toDF("node", "root"))
