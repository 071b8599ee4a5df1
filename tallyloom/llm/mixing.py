"""Mixing sources to target weights: budgets down a tree, shortages first among siblings, prefixes of seeded epochs."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.session import cut


@dataclass
class Node:
    name: tuple
    weight: float = 0.0
    room: float = 0.0  # tokens that it can give at most
    budget: float = 0.0
    children: dict = field(default_factory=dict)


def plant(leaves: dict[tuple, tuple[float, float]]) -> Node:
    """A tree from path -> (weight, room); a node's weight and room are the sums of its children's."""
    root = Node(())
    for path, (weight, room) in sorted(leaves.items(), key=lambda x: tuple(map(str, x[0]))):
        node = root
        node.weight, node.room = node.weight + weight, node.room + room
        for i in range(len(path)):
            node = node.children.setdefault(path[i], Node(path[: i + 1]))
            node.weight, node.room = node.weight + weight, node.room + room
    return root


def share_out(node: Node, budget: float) -> float:
    """Gives the budget to the node's leaves by weight and returns what it can't place. What a child can't place goes to its
    siblings by weight, as far as they have room; only what all of them can't take goes back to the ancestor."""
    if not node.children:
        node.budget = min(budget, node.room)
        return budget - node.budget
    given = {k: 0.0 for k in node.children}
    left = budget
    open_ = {k for k, c in node.children.items() if c.weight > 0 and c.room > 0}
    while left > 1e-9 * max(1.0, budget) and open_:
        total = sum(node.children[k].weight for k in open_)
        spare = 0.0
        for k in sorted(open_, key=str):
            c = node.children[k]
            want = given[k] + left * c.weight / total
            if want >= c.room:
                spare += want - c.room
                want = c.room
            given[k] = want
        open_ = {k for k in open_ if given[k] < node.children[k].room * (1 - 1e-12)}
        left = spare
    for k, c in node.children.items():
        left += share_out(c, given[k])
    node.budget = budget - left
    return left


def leaves_of(node: Node) -> dict[tuple, float]:
    if not node.children:
        return {node.name: node.budget}
    return {p: b for c in node.children.values() for p, b in leaves_of(c).items()}


def largest_total(targets: dict, room: dict) -> float:
    """The greatest total at which every source that has tokens and a target gets its share (targets of sources without tokens
    fall to the others)."""
    there = {s: t for s, t in targets.items() if t > 0 and room.get(s, 0) > 0}
    total = sum(there.values())
    return min((room[s] * total / t for s, t in there.items()), default=0.0)


def mixture(documents: DataFrame, targets: DataFrame, key: str, source: str, levels: tuple[str, ...], tokens: str, text_hash: str, total_tokens: float | None = None, slices: int = 4096, seed: int = 5, stretch: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares). chosen: (key, source, epoch, tokens), one row per use of a text; shares: (source, target_share,
    max_repeats, available_tokens, budget_tokens, tokens, share, repeats): one row per target, share being the part of all
    chosen tokens and repeats the largest number of uses of one text.

    targets: (source, target_share, max_repeats). levels: the columns above the source in the tree, outermost first; a
    source's target is divided over its places in the tree by their tokens. total_tokens is by default the greatest total at
    which every source with documents gets its share; with a larger one small sources give all they may and their shortage
    is redistributed, among siblings before ancestors. stretch: the total is at least so many times that greatest one.

    Texts that are equal within a source (by text_hash) are one text, under its smallest key. Epoch e orders a leaf's texts
    by a hash of seed, e and key; all epochs but the last are whole, the last ends with the text
    whose middle is the last to lie within the budget. Documents with a null key, source or tokens, without tokens or without a target aren't
    used; a target without documents gets nothing and is reported. Of repeated targets the first by share counts. Empty
    tables give no rows.

    Scale: only sums per leaf come to the driver (as many as there are targets times places). A leaf's prefix is found from
    sums over `slices` slices of its hash range, so no task orders a whole leaf: only the slice in which the budget ends is
    ordered by single texts.
    """
    spark = documents.sparkSession
    goals = targets.select(F.col("source").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")).where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0")
    wanted: dict = {}
    for r in sorted(goals.collect(), key=lambda r: (r["source"], -r["target_share"], -r["max_repeats"])):  # a side table of fixed size
        wanted.setdefault(r["source"], (r["target_share"], r["max_repeats"]))
    rows = documents.select(F.col(key).alias("key"), F.col(source).alias("source"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"level_{i}") for i, c in enumerate(levels)], F.col(tokens).cast("long").alias("tokens"), F.col(text_hash).alias("hash"))
    rows = rows.where(F.col("key").isNotNull() & F.col("source").isin(*wanted) & (F.col("tokens") > 0))
    places = [f"level_{i}" for i in range(len(levels))]
    texts = rows.groupBy("source", "hash").agg(F.min(F.struct("key", *places, "tokens")).alias("x")).select("source", "x.*")
    texts = cut(texts)
    sums = texts.groupBy(*places, "source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("texts")).collect()
    available: dict = defaultdict(int)
    for r in sums:
        available[r["source"]] += r["tokens"]
    room = {s: available[s] * wanted[s][1] for s in available}
    largest = largest_total({s: w[0] for s, w in wanted.items()}, room)
    total = max(largest if total_tokens is None else total_tokens, stretch * largest)
    tree = plant({(*[r[p] for p in places], r["source"]): (wanted[r["source"]][0] * r["tokens"] / available[r["source"]], float(r["tokens"] * wanted[r["source"]][1])) for r in sums})
    share_out(tree, total)
    budgets = leaves_of(tree) if tree.children else {}
    size = {(*[r[p] for p in places], r["source"]): r["tokens"] for r in sums}
    plan = []
    for path, budget in budgets.items():
        whole = min(int(budget // size[path] + 1e-9), wanted[path[-1]][1])
        rest = 0 if whole >= wanted[path[-1]][1] else int(round(budget - whole * size[path]))
        plan.append((*path, whole, max(0, rest)))
    shape = ", ".join([*(f"{p} string" for p in places), "source string, whole int, rest long"])
    kind = documents.schema[key].dataType.simpleString()
    if not plan:
        chosen = spark.createDataFrame([], f"{key} {kind}, source string, epoch int, tokens long")
    else:
        leaf = [*places, "source"]
        marked = texts.join(F.broadcast(spark.createDataFrame(plan, shape)), leaf)  # one row per leaf
        epochs = marked.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("whole")))).select("key", "source", "epoch", "tokens")
        last = marked.where("rest > 0").withColumn("h", F.xxhash64(F.lit(seed), F.col("whole"), "key")).withColumn("slice", F.pmod("h", F.lit(slices)))
        by_slice = last.groupBy(*leaf, "rest", "slice").agg(F.sum("tokens").alias("t"))
        before = by_slice.withColumn("before", F.sum("t").over(W.partitionBy(*leaf).orderBy("slice").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("t"))
        edges = before.where(F.col("before") < F.col("rest")).select(*leaf, "slice", "before", (F.col("before") + F.col("t") > F.col("rest")).alias("edge"))
        near = last.join(edges, [*leaf, "slice"])
        inside = near.where("NOT edge")
        running = F.col("before") + F.sum("tokens").over(W.partitionBy(*leaf, "slice").orderBy("h", "key").rowsBetween(W.unboundedPreceding, W.currentRow))
        cutting = near.where("edge").withColumn("upto", running).where("2 * upto - tokens <= 2 * rest")
        partial = inside.select("key", "source", "whole", "tokens").union(cutting.select("key", "source", "whole", "tokens"))
        chosen = epochs.union(partial.select("key", "source", (F.col("whole") + 1).alias("epoch"), "tokens")).withColumnRenamed("key", key)
    chosen = cut(chosen)
    reached = chosen.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("epoch").alias("repeats"))
    by_source: dict = defaultdict(float)
    for path, b in budgets.items():
        by_source[path[-1]] += b
    report = spark.createDataFrame([(s, w[0], w[1], available.get(s, 0), float(by_source.get(s, 0.0))) for s, w in wanted.items()], "source string, target_share double, max_repeats int, available_tokens long, budget_tokens double")
    all_ = chosen.agg(F.sum("tokens").alias("all"))
    shares = report.join(reached, "source", "left").crossJoin(F.broadcast(all_))  # one row
    shares = shares.select("source", "target_share", "max_repeats", "available_tokens", F.round("budget_tokens", 3).alias("budget_tokens"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)), 6).alias("share"), F.coalesce("repeats", F.lit(0)).alias("repeats"))
    return chosen, shares
