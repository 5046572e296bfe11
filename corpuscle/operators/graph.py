"""Connected components of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.operators.tables import staged


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of the links of ``edges`` (two columns); root is the smallest node linked with it.

    Each round hangs the larger neighbours of a node, then the smaller ones, on the least of its neighbourhood, so
    stars replace chains. Links stay rows; no neighbourhood is gathered. Null ends and loops link nothing more.
    """
    a, b = (F.col(c) for c in edges.columns)
    some = edges.where(a.isNotNull() & b.isNotNull())
    nodes = staged(some.select(a.alias("node")).union(some.select(b)).distinct())
    links = staged(some.where(a != b).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct())
    before = None
    while True:
        both = links.union(links.select("u", "v"))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = staged(both.join(least, "v").where("u > v and u != m").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct())
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(low, "v")
        small = joined.where("u != m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(low.select("v", F.col("m").alias("u")))
        links = staged(small.distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = links.groupBy("v").agg(F.min("u").alias("root"))
    return nodes.join(roots, nodes["node"] == roots["v"], "left").select("node", F.coalesce("root", "node").alias("root"))
