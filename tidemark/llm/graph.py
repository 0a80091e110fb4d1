"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.staging import stage_table


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links (a, b)``; the root is the smallest node reached.

    Each round is two aggregations and joins over the links and is written to the shared folder;
    the number of rounds grows with the logarithm of the size of the largest component. The
    smallest neighbours are stored tables too, so that Spark can split the links of a node that
    has very many. Links to itself and repeated links do no harm; links with a null end are
    ignored.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    now = stage_table(links.select("a", "b").distinct(), "links")
    before = None
    while True:
        # Large star: every larger neighbour is linked to the smallest of the neighbourhood.
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        least = stage_table(least, "least")
        large = (
            both.join(least, "a")
            .where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        # Small star: the node and its smaller neighbours are linked to the smallest of them.
        large = stage_table(large, "large")
        least = stage_table(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stage_table(small.union(least.select("a", F.col("m").alias("b"))).where(
            F.col("a") != F.col("b")
        ).distinct(), "links")
        state = now.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == before:
            break
        before = state
    nodes = links.select("a").union(links.select("b")).distinct()
    return nodes.join(now.withColumnRenamed("b", "m"), "a", "left").select(
        F.col("a").alias("node"), F.coalesce("m", "a").alias("root")
    )
