"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is the smallest node reachable.

    Self links and repeated links are harmless, null ends are ignored, an empty table gives no rows. Every step is a
    grouped minimum, which combines before it shuffles, and an equi-join whose skewed keys Spark can split; links
    shrink to one per node within O(log^2 n) rounds, and each round is written to the shared folder.
    """
    links = stored(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links"
    )
    state = _digest(links)
    while state[0]:
        stars = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stars.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stars.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        after = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        dropped(large)
        dropped(links)
        links, before, state = after, state, _digest(after)
        if before == state:
            break
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
