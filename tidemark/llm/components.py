"""Connected components of an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import dropped, written


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node's smaller neighbours, and the node, to the least of them. ``edges``: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the least of its neighbours and itself. ``edges``: u > v.

    That least is the node itself unless it is some edge's u, so the least of a component, to which very many may be
    linked, finds no partner in the join: its rows go on as they are, and may be split at will.
    """
    least = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    return edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """u and v for each node u that isn't the least of its component: v is that least node.

    ``edges`` has the columns u and v of one ordered type, in any direction; loops and repeats don't matter. Rounds follow
    one another until nothing changes, each written to the shared folder; their number grows with the logarithm of the
    longest chain. Minima are summed up before each shuffle, and a node with very many neighbours is split by the join.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        edges, last = written(_small_star(_large_star(edges)), "edges"), edges
        dropped(last)
        now = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.expr("sum(xxhash64(v, u) % 1000003)").alias("s")).first()
        if now == before:
            return edges
        before = now
    raise RuntimeError(f"the components haven't settled after {most_rounds} rounds")
