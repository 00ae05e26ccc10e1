"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is a minimum per node and a join back, so a node with very many edges is pre-aggregated and its join split. Every pair of
steps is written to the shared folder; only a count and a checksum reach the driver.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import land


def _ordered(e: DataFrame) -> DataFrame:
    return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _mark(e: DataFrame):
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) but the smallest of its component, with that smallest node."""
    e = land(_ordered(edges).distinct(), "cc")
    before = None
    while (now := _mark(e)) != before:
        before = now
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _ordered(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("a", F.col("m").alias("b")).union(small.select("b", "m"))
        e = land(_ordered(small).distinct(), "cc")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
