"""Connected components of a table of links, by alternating stars.

Each round sends every node's larger neighbours, then its smaller ones, to the least node
nearby; the number of links never grows and after a few rounds each component is a star
around its least node. Minima are pre-aggregated before the shuffle, so a node with a very
great number of links is no single task. They are written before they are joined, so that both
sides of the join are dealt anew and adaptive execution can split such a node's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import stash


def _checksum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def stars(links: DataFrame) -> DataFrame:
    """(u, v) for each node u that is not the least of its component, v being the least; links: (u, v) long, in any direction."""
    cur = stash(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    before = _checksum(cur)
    while before[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = cur.select(F.col("v").alias("n"), F.col("u").alias("w")).join(least.withColumnRenamed("u", "n"), "n").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = stash(large.filter("u <> v").distinct(), "large-star")
        lower = stash(large.groupBy("u").agg(F.min("v").alias("m")), "lower")
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v")))
        cur = stash(small.filter("u <> v").distinct(), "small-star")
        after = _checksum(cur)
        if after == before:
            break
        before = after
    return cur
