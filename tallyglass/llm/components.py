"""Connected components of a graph given as a table of links, by alternating large-star and small-star steps.

Each round rewires every link towards the least identifier it can see; after about log(n) rounds every node links to
the least node of its component. Minima are aggregated before they are shuffled, and links meet their minima in a join
of two plain exchanges, which adaptive execution splits where one node has very many links. Each round is written to
the shared folder, so lineage stays short and lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import materialize


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node of its component, for every node that has a link to another; `links` has a, b (long)."""
    now = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now = materialize(now, "links")
    before, seen = None, _signature(now)
    while seen != before and seen[0]:
        before = seen
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        large = materialize(large, "large-star")
        least = materialize(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        moved = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = materialize(moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), "small-star")
        seen = _signature(now)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
