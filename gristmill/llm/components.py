"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _smaller_than(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, u > v."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def large_star(edges: DataFrame) -> DataFrame:
    """Hook the larger neighbours of each node on its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Hook each node and its smaller neighbours on the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    hooked = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.unionByName(low.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """Stars (u, v): v is the smallest node of u's component; u is never v, nodes without links are absent.

    ``links`` has long columns u and v in any order, repeats and loops allowed.
    Each round is written to the shared folder, so lost executors cost one
    round; nothing but a count comes to the driver.
    """
    edges = written(_smaller_than(links), "links")
    before = _state(edges)
    while before[0]:
        nxt = written(small_star(written(large_star(edges).where("u <> v").distinct(), "large")).distinct(), "small")
        discard(edges)
        edges, after = nxt, _state(nxt)
        if after == before:
            break
        before = after
    return edges
