"""Connected components of links between numbers, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.llm.common import cut


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One round: every node hangs its larger (large) or smaller (small) neighbours on its smallest neighbour.

    The smallest neighbour comes from a partial aggregate and a join that Spark may split, so a hub isn't one task.
    """
    if large:
        near = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = near.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = links.groupBy("u").agg(F.min("v").alias("m"))
        out = links.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.where("u > v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of a link; root is the smallest number that it reaches.

    A round is two joins and a table in the shared folder; rounds grow with the logarithm of the longest path. Ends when
    a round changes nothing, which a count and a sum of hashes over all links tell. Links with a null are left out.
    """
    big, small = F.greatest(a, b), F.least(a, b)
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = cut(links.select(big.alias("u"), small.alias("v")).distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1000003)).first())

    before, now = None, state(links)
    while now != before:
        links = cut(_stars(_stars(links, True), False))
        before, now = now, state(links)
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(links.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
