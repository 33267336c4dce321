"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, salted_join, stored


def connected_components(links: DataFrame) -> DataFrame:
    """Rows (id, component) for every id in `links` (a, b), a table; the component is its smallest id.

    Each round links every larger neighbour of a node to the node's smallest one (large star), then a node and
    its smaller neighbours to their smallest (small star). Rounds end when the links stay the same, which takes
    about the logarithm of the longest path. Links are tables in the shared folder throughout, removed when done; the
    driver sees only their number and a checksum. A node with very many links is dealt over several tasks. An
    empty table gives an empty one; self links and nulls are left out.
    """
    before = scratch = Scratch(links.sparkSession)
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        seen = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if not seen["n"] or (seen["n"], seen["x"]) == mark:
            break
        mark = (seen["n"], seen["x"])
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = salted_join(both.where("v > u"), low, "u", "v", 2 * seen["n"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = salted_join(large, low, "u", "v", 2 * seen["n"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        scratch = Scratch(links.sparkSession)
        edges = scratch.keep(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        before.clear()
        before = scratch
    roots = edges.groupBy("u").agg(F.min("v").alias("component"))
    out = stored(roots.select(F.col("u").alias("id"), "component").union(edges.select("v", "v").distinct()))
    before.clear()
    return out
