"""Per-key work without the imbalance that a few large keys cause: fragment and replicate by measured load.

Loads are counted per key (combined before the shuffle). A key above a task's fair share is split into shards in
proportion to its load; there can be at most `tasks` such keys, whatever the data, and only they and the loads of a fixed
number of hash buckets for all other keys come to the driver. Buckets and shards are packed onto the tasks, heaviest
first onto the least loaded. Rows carry their task's number and are placed by it; a matching side is sent to the tasks of
the shards of its key and nowhere else.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import partitions


TASK = "_task"  # the column that rows are placed by; a column of this name in the input is replaced


@dataclass
class Placement:
    """large: key -> tasks of its shards, at most `tasks` keys. small: task of each hash bucket."""

    tasks: int
    large: dict
    small: list[int]
    loads: list[int]

    def task(self, key: Column, shard_by: Column) -> Column:
        """The task of a row; the rows of a large key are spread by the hash of shard_by."""
        bucket = F.pmod(F.xxhash64(key), F.lit(len(self.small)))
        place = F.element_at(F.array(*[F.lit(t) for t in self.small]), (bucket + 1).cast("int"))
        if self.large:
            shards = F.create_map(*[x for k, v in self.large.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])[key]
            at = F.pmod(F.xxhash64(shard_by, F.lit(7)), F.size(shards)) + 1
            place = F.when(key.isin(*self.large), F.element_at(shards, at.cast("int"))).otherwise(place)
        return place.cast("int")

    def tasks_of(self, key: Column) -> Column:
        """All tasks that may hold rows of the key, as an array."""
        bucket = F.pmod(F.xxhash64(key), F.lit(len(self.small)))
        place = F.array(F.element_at(F.array(*[F.lit(t) for t in self.small]), (bucket + 1).cast("int")))
        if self.large:
            shards = F.create_map(*[x for k, v in self.large.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in sorted(set(v))]))])[key]
            place = F.when(key.isin(*self.large), shards).otherwise(place)
        return place


def pack(items: list[tuple[int, object]], tasks: int) -> tuple[list[tuple[object, int]], list[int]]:
    """Each (load, name) onto one of the tasks: heaviest first onto the task with the least so far."""
    heap = [(0, t) for t in range(tasks)]
    placed = []
    for load, name in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        so_far, t = heapq.heappop(heap)
        placed.append((name, t))
        heapq.heappush(heap, (so_far + load, t))
    loads = [0] * tasks
    for load, t in heap:
        loads[t] = load
    return placed, loads


def placement(loads: DataFrame, tasks: int | None = None, split: float = 0.5, buckets_per_task: int = 16) -> Placement:
    """loads: (key, load), one row per key. A key whose load exceeds split x a task's fair share gets shards of about that
    size. What comes to the driver has a size fixed by tasks: up to tasks / split keys and the buckets' loads."""
    tasks = tasks or partitions(loads.sparkSession)
    width = tasks * buckets_per_task
    total = loads.agg(F.sum("load")).first()[0] or 0
    share = max(1.0, total / tasks * split)
    big = {r["key"]: r["load"] for r in loads.where(F.col("load") > share).collect()}
    rest = loads.where(F.col("load") <= share).groupBy(F.pmod(F.xxhash64("key"), F.lit(width)).alias("b")).agg(F.sum("load").alias("load")).collect()
    items: list[tuple[int, object]] = [(r["load"], ("bucket", r["b"])) for r in rest]
    for k, load in big.items():
        n = min(tasks, -(-load // int(share)))
        items += [(-(-load // n), ("key", k, i)) for i in range(n)]
    placed, by_task = pack(items, tasks)
    large: dict = {k: [] for k in big}
    small = [b % tasks for b in range(width)]
    for name, t in placed:
        if name[0] == "key":
            large[name[1]].append(t)
        else:
            small[name[1]] = t
    return Placement(tasks, large, small, by_task)


def balanced(rows: DataFrame, key: str, shard_by: str, plan: Placement, matching: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """rows placed by plan, with the column TASK. If a matching side is given (its key column named alike), it is sent to
    the tasks of its keys' shards and joined there; columns of it that rows has as well get the suffix _right. how is
    inner or left. Rows with a null key match nothing. Both sides are placed by their task's number, so the join adds no
    exchange of its own."""
    here = rows.withColumn(TASK, F.coalesce(plan.task(F.col(key), F.col(shard_by)), F.lit(0)))
    if matching is None:
        return here.repartitionById(plan.tasks, TASK)
    names = {c: f"{c}_right" if c in here.columns and c != key else c for c in matching.columns}
    there = matching.select(*[F.col(c).alias(n) for c, n in names.items()])
    there = there.withColumn(TASK, F.explode(plan.tasks_of(F.col(key))))
    return here.repartitionById(plan.tasks, TASK).join(there.repartitionById(plan.tasks, TASK), [TASK, key], how)


def per_key(rows: DataFrame, key: str, record: str, plan: Placement) -> DataFrame:
    """(key, records): the number of distinct records of each key. A large key's shards hold different records, as rows are
    spread by record, so the shards' numbers add up."""
    placed = balanced(rows.where(F.col(key).isNotNull() & F.col(record).isNotNull()), key, record, plan)
    one = placed.groupBy(TASK, key, record).agg(F.lit(1).alias("one"))
    return one.groupBy(TASK, key).agg(F.count(F.lit(1)).alias("records")).groupBy(key).agg(F.sum("records").alias("records"))
