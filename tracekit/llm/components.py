"""Connected components of links between names, by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracekit.session import cut


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row.n, row.h


def components(links: DataFrame) -> DataFrame:
    """``name``, ``root`` of every name in links ``a``, ``b``: the root is the component's smallest name.

    Each round replaces links by shorter ones: first every name hands its larger neighbours to the smallest one
    it knows, then its smaller ones. Each half round is one aggregation and one join over the links, written to the shared
    folder; the number of rounds grows with the logarithm of the longest path. No links give no rows.
    """
    links = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _state(links)
    while before[0]:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large, "links")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = moved.union(low.select("a", F.col("m").alias("b"))).distinct()
        links = cut(small, "links")
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("name"), F.col("b").alias("root")).union(links.select(F.col("b").alias("name"), F.col("b").alias("root"))).distinct()
