"""Groups from pairwise matches by seed-tree pruning.

Each round every vertex tells its neighbourhood the least vertex it sees. A vertex that isn't the least for anyone, itself
included, leaves the graph and hangs below the least vertex that it heard of; the others are linked to that vertex and go
on. A vertex left without edges is a seed. The forest of those that left is then walked from the last round to the first,
and each takes the seed of the vertex it hangs below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))


def group_matches(pairs: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, group): each node of at least one pair of two different nodes, and the least node linked to it directly or
    through others. Nodes may be of any type that has an order (strings by code point).

    Pairs with a null end or with twice the same node link nothing; repeated and reversed pairs count once; an empty
    table gives no rows. All state is in tables: minima are combined before the shuffle, so a vertex with a third of all
    pairs sends one row per map task; the join with the minima has one row per vertex on its other side, which adaptive
    skew joins may split. Rounds grow as the logarithm of the longest chain; not settling in max_rounds is an error.
    """
    ends = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    live = cut(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    nodes = _both(live).select(F.col("u").alias("node")).distinct()
    left: list[DataFrame] = []
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        both = _both(live)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        told = both.join(least, "u")
        heard = cut(told.select(F.col("v").alias("x"), "m").union(least.select(F.col("u").alias("x"), "m")).distinct())
        best = heard.groupBy("x").agg(F.min("m").alias("best"))
        chosen = heard.select(F.col("m").alias("x")).distinct().withColumn("stays", F.lit(True))
        left.append(cut(best.join(chosen, "x", "left_anti").select(F.col("x").alias("node"), F.col("best").alias("below"))))
        links = heard.join(best, "x").where("m <> best")
        live = cut(links.select(F.least("m", "best").alias("u"), F.greatest("m", "best").alias("v")).distinct())
    else:
        raise RuntimeError(f"groups did not settle in {max_rounds} rounds")
    # vertices that never left are seeds
    known = None
    for tree in reversed(left):
        if known is None:
            found = tree.select("node", F.col("below").alias("group"))
        else:
            found = tree.join(known.withColumnRenamed("node", "below"), "below", "left").select("node", F.coalesce("group", "below").alias("group"))
        known = cut(found if known is None else known.union(found))
    if known is None:
        return nodes.select("node", F.col("node").alias("group"))
    return nodes.join(known, "node", "left").select("node", F.coalesce("group", "node").alias("group"))
