"""Filling containers of fixed capacity by minimum bin slack.

Items are spread over shards of bounded size by hash, and each shard fills its own containers. A container starts with the
longest item left; over the lengths still available a dynamic programme on bitsets (bit s: a sum of s can be reached) finds
the fullest feasible combination, which is taken out. A combination is repeated as long as the shard has its lengths, so
the work follows the number of different combinations, not the number of items.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """The lengths of a combination with the greatest sum of at most room. lengths: those with counts > 0, longest first; each
    may be used as often as it is counted."""
    mask = (1 << (room + 1)) - 1
    reach, steps, goal = 1, [], 1 << room
    for n in lengths:
        if n > room:
            continue
        have, part = min(counts[n], room // n), 1
        while have > 0:  # 1, 2, 4, ... copies at a time
            take = min(part, have)
            wider = reach | ((reach << (n * take)) & mask)
            if wider != reach:
                steps.append((n, take, reach))
                reach = wider
            have -= take
            part *= 2
        if reach & goal:
            break
    at = reach.bit_length() - 1
    used = []
    for n, take, before in reversed(steps):
        if not before >> at & 1:
            used += [n] * take
            at -= n * take
    return used


def fill(lengths: list[int], capacity: int) -> Iterator[tuple[list[int], int]]:
    """(combination, times): containers that together hold all lengths, none of which is above capacity."""
    counts: dict[int, int] = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    order = sorted(counts, reverse=True)
    while order:
        seed = order[0]
        counts[seed] -= 1
        free = order if counts[seed] else order[1:]
        combination = [seed, *fullest(counts, free, capacity - seed)] if capacity > seed else [seed]
        counts[seed] += 1
        need: dict[int, int] = defaultdict(int)
        for n in combination:
            need[n] += 1
        times = min(counts[n] // k for n, k in need.items())
        for n, k in need.items():
            counts[n] -= k * times
        if any(counts[n] == 0 for n in need):
            order = [n for n in order if counts[n]]
        yield combination, times


def pack(items: DataFrame, key: str, size: str, capacities: DataFrame, shard_items: int = 20_000, count: int | None = None) -> DataFrame:
    """(capacity_id, container, key, piece, start, size, capacity): which piece of which item lies in which container.

    An item above the capacity is cut into full pieces, each a container of its own, and a rest that is packed like an
    item; no other item is cut. Items with a null key or size or of size 0 or less have nothing to pack and don't come
    out; of one key's repeated rows each is packed. container is unique within a capacity. A capacity that is null or below
    1 is left out. Items are spread by the hash of their key and size over ceil(items / shard_items) shards; a shard's
    loss is a few containers, so a larger shard_items loses less.
    """
    rows = items.select(F.col(key).alias("key"), F.col(size).cast("long").alias("size")).where("key IS NOT NULL AND size > 0")
    count = rows.count() if count is None else count
    shards = max(1, -(-count // shard_items))
    limits = capacities.select(F.col("capacity_id").cast("int").alias("capacity_id"), F.col("capacity_tokens").cast("long").alias("capacity")).where("capacity_id IS NOT NULL AND capacity >= 1").distinct()
    spread = rows.withColumn("shard", F.pmod(F.xxhash64("key", "size"), F.lit(shards)).cast("int"))
    each = [(int(r[0]), int(r[1])) for r in limits.collect()]  # a side table of fixed size
    if not each:
        each = [(0, 0)]
        spread = spread.limit(0)
    spread = spread.withColumn("c", F.explode(F.array(*[F.struct(F.lit(i).alias("capacity_id"), F.lit(c).cast("long").alias("capacity")) for i, c in each]))).select("shard", "c.capacity_id", "c.capacity", "key", "size")
    kind = items.schema[key].dataType.simpleString()

    def run(t: pd.DataFrame) -> pd.DataFrame:
        shard, capacity_id, capacity = int(t["shard"].iat[0]), int(t["capacity_id"].iat[0]), int(t["capacity"].iat[0])
        t = t.sort_values(["size", "key"], kind="stable")
        keys, sizes = t["key"].tolist(), t["size"].tolist()
        out: list[tuple] = []
        waiting: dict[int, list[tuple]] = defaultdict(list)
        container = 0
        for k, n in zip(keys, sizes):
            full = (n - 1) // capacity  # a rest is left, of a whole container at most
            for p in range(full):
                out.append((container, k, p, p * capacity, capacity))
                container += 1
            waiting[n - full * capacity].append((k, full, full * capacity))
        rests = [n for n, w in waiting.items() for _ in w]
        for combination, times in fill(rests, capacity):
            for _ in range(times):
                for n in combination:
                    k, p, start = waiting[n].pop()
                    out.append((container, k, p, start, n))
                container += 1
        found = pd.DataFrame(out, columns=["container", "key", "piece", "start", "size"])
        found["container"] = found["container"] + (shard << 32)
        found.insert(0, "capacity_id", capacity_id)
        found["capacity"] = capacity
        return found

    shape = f"capacity_id int, container long, key {kind}, piece int, start long, size long, capacity long"
    return spread.groupBy("shard", "capacity_id").applyInPandas(run, shape).withColumnRenamed("key", key)


def filling(packed: DataFrame) -> DataFrame:
    """(capacity_id, capacity, containers, items, tokens, fill): one row per capacity; fill is tokens by room."""
    by = packed.groupBy("capacity_id", "capacity", "container").agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("tokens"))
    total = by.groupBy("capacity_id", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"))
    return total.withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
