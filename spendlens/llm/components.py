"""Connected components of a link table, by alternating star contraction in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _centres(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the least of u and its neighbours."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    centres = _centres(both).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(centres, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u, are linked to the least of them."""
    joined = links.join(_centres(links), "u")
    moved = joined.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(_centres(links).select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of a link: root is the least node of its component.

    ``links`` has two columns of one orderable type; direction, repeats and self-links do
    not matter. Each round is checkpointed, so lineage stays short and a lost executor
    costs one round. The number of rounds grows with the logarithm of the longest path.
    """
    first, second = links.columns[:2]
    pairs = links.select(
        F.greatest(first, second).alias("u"), F.least(first, second).alias("v")
    ).filter("u > v").distinct().checkpoint()
    state = None
    while True:
        pairs = _small_star(_large_star(pairs)).distinct().checkpoint()
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
