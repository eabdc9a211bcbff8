"""Connected components of an edge table, in rounds of DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import Shelf


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, or none and only larger ones: nothing is left to do."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up")))
    return not ends.groupBy("x").agg(F.sum("up").alias("n"), F.min("up").alias("m")).filter("n > 1 or (n = 1 and m = 0)").agg(F.count("*")).first()[0]


def components(edges: DataFrame, shelf: Shelf, name: str = "cc") -> DataFrame:
    """(node, root) for every node of edges (u, v): the smallest node that can be reached.

    Alternates two steps until only stars are left: every node hands its larger neighbours to its
    smallest one, then its smaller neighbours likewise. Each step is an aggregation with partial
    sums and a join that the engine can split, so a node with very many neighbours is no
    hot spot. Rounds grow with the logarithm of the longest path.
    """
    now = shelf.put(f"{name}-0", edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    r = 0
    while not _stars(now):
        r += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        handed = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = shelf.put(f"{name}-{r}", handed.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        shelf.drop(f"{name}-{r - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
