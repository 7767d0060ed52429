"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkin.llm import common
from loomkin.llm.common import discard, materialize

ROUNDS = 60


def _least(edges: DataFrame, n: int) -> DataFrame:
    """(b, m): each node's smallest smaller neighbour, of n edges at most.

    Broadcast if that bound allows it; else written, so that a join on it can be split where a node is hot.
    """
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    return F.broadcast(least) if n <= common.BROADCAST_ROWS else materialize(least, "least")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each edge (a, b) moves from a to a's smallest neighbour; an a without a smaller one keeps its edges."""
    least = _least(edges, n).withColumnRenamed("b", "a")
    return edges.join(least, "a", "left").select(F.coalesce("m", "a").alias("a"), "b").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Each b links its smaller neighbours and itself to the smallest of them."""
    met = edges.join(_least(edges, n), "b")
    both = F.when(F.col("a") > F.col("m"), F.array("a", "b")).otherwise(F.array("b"))
    return met.select(F.col("m").alias("a"), F.explode(both).alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for nodes with an edge (a, b) of two different nodes."""
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    edges, before = materialize(edges, "edges"), None
    n = edges.count()
    for _ in range(ROUNDS if n else 0):
        moved = materialize(_large_star(edges, n), "large")  # no more edges than before
        edges = materialize(_small_star(moved, n), "small")
        discard(moved)
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(xxhash64(b, a) as decimal(38, 0)))")).first()
        if now == before:
            break
        before, n = now, now[0]
    else:
        if n:
            raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
