"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import shared_dir


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of each linked node: columns ``node``, ``root`` (the component's smallest node).

    links: columns ``u``, ``v`` of one ordered type; direction, repeats and loops don't matter, nulls
    are left out. Each round points nodes at the smallest neighbour with two grouped minimums and
    joins, so only links are shuffled; a round's links are cut from their lineage by checkpoint().
    The driver sees two numbers a round. Nodes without a link aren't returned.
    """
    shared_dir(links.sparkSession)
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # A node keeps a link to its smallest neighbour; the others are linked to that neighbour.
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        edges = small.union(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v")).groupBy("node").agg(F.min("root").alias("root"))
