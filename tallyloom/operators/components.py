"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut


def _towards_less(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (v, u) with u < v; loops fall away."""
    return pairs.select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).where("u < v").distinct()


def _large_star(pairs: DataFrame) -> DataFrame:
    """Each vertex links its greater neighbours to the least of its neighbourhood."""
    both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _towards_less(both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v"))


def _small_star(pairs: DataFrame) -> DataFrame:
    """Each vertex links itself and its lesser neighbours to the least of them. pairs has u < v."""
    least = pairs.groupBy("v").agg(F.min("u").alias("m"))
    moved = pairs.join(least, "v")
    return _towards_less(moved.select(F.col("m").alias("u"), F.col("u").alias("v")).union(moved.select(F.col("m").alias("u"), "v")))


def components(pairs: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): each node of at least one pair, and the least node of its component.

    Pairs with a null end say nothing; a pair of a node with itself makes that node its own component. Ties, repeated and
    reversed pairs change nothing. Each round is an aggregate and a join on a vertex; the least neighbour is combined
    before the shuffle and is one row per vertex, so that a vertex with a third of all pairs can be split by adaptive
    skew joins. Rounds grow as the logarithm of the number of nodes; each is cut from its lineage. Running out of rounds
    is an error.
    """
    ends = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    edges = cut(_towards_less(ends))
    nodes = ends.select(F.col("u").alias("node")).union(ends.select(F.col("v").alias("node"))).distinct()
    before = None
    for _ in range(max_rounds):
        edges = cut(_small_star(_large_star(edges)))
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(edges.select(F.col("v").alias("node"), F.col("u").alias("least")), "node", "left").select("node", F.coalesce("least", "node").alias("component"))
