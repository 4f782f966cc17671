"""Connected components of a graph of links, as rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.session import written

MAX_ROUNDS = 64


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them. Edges run from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v")))


def _settled(edges: DataFrame) -> tuple[DataFrame, tuple]:
    table = written(edges.where(F.col("u") != F.col("v")).distinct())
    sums = table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return table, tuple(sums)


def components(links: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, root) of every linked node but the roots themselves; the root is the smallest node of a component.

    Alternates two rounds of star contraction until the edges stay as they are, which takes a number of rounds that
    grows with the logarithm of the longest path. Each round is written to the shared folder, so a lost executor costs
    one round. Links with a null end are left out.
    """
    u, v = F.col(left), F.col(right)
    edges = links.where(u.isNotNull() & v.isNotNull()).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    edges, before = _settled(edges)
    for _ in range(MAX_ROUNDS):
        edges, now = _settled(_small_star(_large_star(edges)))
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
