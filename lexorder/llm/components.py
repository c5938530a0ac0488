"""Connected components of a table of links, by alternating large and small stars.

Each round is written to the shared folder and read back.  A node's least neighbour is an
aggregate, summed up before the shuffle, so a hub with many links is no single group; the join
that hands the least neighbour out has one row per node on one side, which adaptive execution
splits on the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexorder.staging import Stages


def _digest(df: DataFrame) -> tuple:
    row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, stages: Stages) -> DataFrame:
    """Links (u, v) of two nodes each to (u, root): the least node that u can reach.

    Nodes without a link, and roots themselves, have no row.
    """
    edges = stages.save(_ordered(links), "links-0")
    before, step = _digest(edges), 0
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select(
            "u", F.least("u", "low").alias("low"))
        large = stages.save(_ordered(
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"),
                                                         F.col("low").alias("v"))),
            f"large-{step}")
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .union(least.select("u", F.col("low").alias("v"))))
        edges = stages.save(_ordered(small), f"links-{step + 1}")
        after = _digest(edges)
        stages.remove(f"links-{step}")
        stages.remove(f"large-{step}")
        step += 1
        if after == before:
            break
        before = after
    return edges.select("u", F.col("v").alias("root"))


def _ordered(edges: DataFrame) -> DataFrame:
    """Each link once, from its larger to its smaller node."""
    return (edges.filter("u <> v").select(F.greatest("u", "v").alias("u"),
                                          F.least("u", "v").alias("v")).distinct())
