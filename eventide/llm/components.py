"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours point to the least node next to it. ``links``: (a, b), a > b."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).where("m < u")
    moved = both.where("v > u").join(least, "u", "left").select(F.col("v").alias("a"), F.coalesce("m", "u").alias("b"))
    return moved.distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, tag: str = "links") -> DataFrame:
    """(node, component) for every node of ``links`` (a, b), any order; component is the least node it reaches.

    Nulls and self-links are dropped; nodes without a link don't appear. Each round writes its links to the shared
    folder, so lineage stays short. Ends when a round changes nothing; a path of n nodes takes about log n rounds.
    """
    links = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    state = None
    while True:
        found = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == state or not found[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = tuple(found)
        links = materialize(_small_star(_large_star(links)), tag)
