"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ledgerline.llm.shared import stored


def _stars(edges: DataFrame) -> DataFrame:
    """One large star and one small star: each node's greater neighbours, then its smaller ones, move to the least."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    joined = large.join(least, "u")
    small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return small.distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) links to (node, component): the smallest node reachable. Nodes without a link to another one are left out."""
    edges = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    for _ in range(rounds):
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20)))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
        edges = stored(_stars(edges), "links")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
