"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.session import materialise

MAX_ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): each id that stands in a link, with the smallest id reachable from it.

    Alternating stars: first every node's larger neighbours are hung on its smallest one, then its
    smaller neighbours, until each component is one star. The links shrink to one a node, minima are
    combined before the shuffle, and each round is a written table, so lineage stays short. Links with
    a null end and links from a node to itself are passed over; repeated links count once.
    """
    edges = (
        links.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    edges = materialise(edges, "links")
    before = _state(edges)
    for _ in range(MAX_ROUNDS):
        edges = materialise(_small_star(_large_star(edges)), "stars")
        after = _state(edges)
        if after == before:
            roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
        before = after
    raise RuntimeError(f"no stable components after {MAX_ROUNDS} rounds")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(
        edges.select(F.col("v").alias("x"), F.col("u").alias("y"))
    )
    least = both.groupBy("x").agg(F.min("y").alias("m"))
    return (
        edges.select(F.col("v").alias("x"), F.col("u").alias("y"))
        .join(least, "x")
        .select(F.col("y").alias("u"), F.least("x", "m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").filter(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).union(hung).distinct()
