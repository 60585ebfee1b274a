"""Connected components of links, by alternating star contractions.

Links with a null end and links of a node with itself are none; repeated links and both directions of one count once.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphworks.llm._shared import remove, written

ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: a < b; b's smaller neighbours meet at the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b")
    return joined.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), "b"))


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, component): the smallest node that each linked node can reach.

    Every round writes its edges to the shared folder, so a lost executor costs one
    round.  Minima are aggregated before rows meet, so a node with very many links is
    no group in one task.
    """
    spark = links.sparkSession
    canonical = lambda e: e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, path = written(canonical(links), "links")
    state = None
    for _ in range(ROUNDS):
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state, old = now, path
        edges, path = written(canonical(_small_star(canonical(_large_star(edges)))), "links")
        remove(spark, old)
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    nodes = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    return nodes.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
