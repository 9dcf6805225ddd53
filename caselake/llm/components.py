"""Connected components by alternating star contraction.

Each round hangs every node's larger neighbours on its smallest one (large star), then its smaller
neighbours (small star); after some log n rounds every component is one star around its smallest id.
A round is two grouped minima and two joins. A hub's edges are many rows of one join key, which the
skew join splits; its minimum is taken in the tasks before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from caselake.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b): node and component (its smallest node) of every node of an edge with two ends."""
    stars = materialise(edges.where(F.col("a") != F.col("b"))
                        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    before = None
    while True:
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")) \
                .unionByName(stars.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        before = tuple(now)
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")) \
            .unionByName(stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u") \
            .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        stars = materialise(small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), "stars")
