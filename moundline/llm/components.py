"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundline.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """node, component: for each node of ``links`` (a, b: long) the least node that it reaches.

    Alternates large-star and small-star steps until the links are stars around their least nodes: none if they are from the start, else a
    number of rounds that grows with the logarithm of the longest path. A star's minimum is found with partial
    aggregation and joined back to one row a node, so a node with very many links is split by the join, never gathered.
    Each round is written, and the driver sees a count only. Null ends are left out; an empty table gives an empty one.
    """
    links = written(links.filter("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct(), "links")
    while not _stars(links):
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Minima are written, so that the joins stand between two exchanges and Spark splits a hot node.
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large-star")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m")), F.struct(F.col("b").alias("a"), F.col("m")))).alias("e"))
        links = written(small.select("e.a", F.col("e.m").alias("b")).filter("a <> b").distinct(), "small-star")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _stars(links: DataFrame) -> bool:
    """Whether no node of distinct ``links``, all from a greater node a to a smaller one b, has two smaller neighbours or both a smaller and a greater one."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("down")))).alias("e")).select("e.*")
    return not ends.groupBy("node").agg(F.sum("down").alias("down"), F.count("*").alias("all")).filter("down > 0 and all > 1").agg(F.count("*")).first()[0]
