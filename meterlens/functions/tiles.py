"""Exact comparison of all members of a group without one row per pair.

Members of a group are hashed into blocks of bounded size. Every pair of blocks forms a tile
that one task evaluates as a matrix product, so a group of any size spreads over many tasks of
equal work and only per-tile (or per-member) reductions leave the tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.functions.skew import salted_lookup

BLOCK_ROWS = 8192
TILE = ("tile_i", "tile_j")


def into_tiles(members: DataFrame, group: Sequence[str], identity: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Repeat each member once per tile of its group.

    Adds ``tile_i <= tile_j`` and ``side``: 0 when the member belongs to block ``tile_i``, else 1.
    In a diagonal tile all members have side 0. The rows come partitioned by tile into a fixed
    number of partitions: a tile is few bytes but much work, so partitions must not be merged by
    their size.
    """
    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(block_rows))).cast("int")
    sized = members.groupBy(*group).agg(blocks.alias("_blocks"))
    placed = salted_lookup(members, sized, group, "inner").withColumn(
        "_block", F.pmod(F.xxhash64(identity), F.col("_blocks")).cast("int")
    )
    return (
        placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumns(
            {
                "tile_i": F.least("_block", "_other"),
                "tile_j": F.greatest("_block", "_other"),
                "side": F.when(F.col("_block") <= F.col("_other"), 0).otherwise(1),
            }
        )
        .drop("_block", "_other", "_blocks")
        .repartition(partitions, *group, *TILE)
    )
