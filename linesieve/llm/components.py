"""Connected components of a link table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def connected_components(edges: DataFrame, space: Workspace) -> DataFrame:
    """(node, component) of every node that has a link to another node; the component is its smallest node.

    `edges` has long columns a and b. Alternates two steps until nothing changes: every node links its larger neighbours
    to its smallest one, then its smaller neighbours and itself to its smallest one. Links turn into stars, in a number
    of rounds that grows with the logarithm of the links. Neighbours are never gathered in a list: the smallest comes
    from a partial aggregate, and the join on a much linked node can be split.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = space.write(links, "links-0")
    mark, k = _mark(links), 0
    while mark[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = space.write(large, f"links-{k + 1}a")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        ).distinct()
        links = space.write(small, f"links-{k + 1}")
        space.drop(f"links-{k}", f"links-{k + 1}a")
        k += 1
        now = _mark(links)
        if now == mark:
            break
        mark = now
    nodes = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(links: DataFrame) -> tuple:
    """Number and order-free hash of the links."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
