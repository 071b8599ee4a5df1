"""Entity features, sessions and balanced keys against plain Python."""

import random

from pyspark.sql import functions as F

from tallyloom.operators.balanced import balanced, pack, per_key, placement
from tallyloom.operators.entity_features import entity_features, event_cells, feature_cells
from tallyloom.operators.records import one_per_id
from tallyloom.operators.sessions import sessions

EVENTS = "entity string, kind string, n string, time double, value double"


def made(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        who = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", "é", "", None])
        rows.append((who, rng.choice(["x", "y", "z", None]), "clash", rng.choice([None, round(rng.uniform(-5, 3e5), 1), 1800.0, 3600.0, 3600.0]), rng.choice([None, 1.5, -2.0])))
    return rows


def expected_cells(rows):
    out = {}
    for e, k, _, t, v in rows:
        if e is not None and k is not None and t is not None:
            n, last, total = out.get((e, k), (0, float("-inf"), 0.0))
            out[e, k] = (n + 1, max(last, t), total + (v or 0.0))
    return out


def test_entity_features_both_layouts(small_batches):
    spark = small_batches
    rows = made(1)
    want = expected_cells(rows)
    cells = event_cells(spark.createDataFrame(rows, EVENTS), "entity", "kind", "time", "value")
    listed = {(r["entity"], r["kind"]): (r["n"], r["last"], r["total"]) for r in feature_cells(entity_features(cells, layout="list", block_cells=4)).collect()}
    assert listed == want
    wide = entity_features(cells, as_of=1e6, layout="wide", block_cells=4)
    names = {f.name: f.metadata["type"] for f in wide.schema if "type" in f.metadata}
    got = wide.collect()
    assert len(got) == len({e for e, _ in want})
    for r in got:
        assert r["n_events"] == sum(n for (e, _), (n, _, _) in want.items() if e == r["entity"])
        for c, k in names.items():
            n, last, total = want.get((r["entity"], k), (0, None, 0.0))
            assert r[c] == (n if c[0] == "n" else total if c[0] == "t" else None if last is None else 1e6 - last)


def test_entity_features_vocabulary_limit_and_empty(spark):
    cells = event_cells(spark.createDataFrame(made(2), EVENTS), "entity", "kind", "time")
    try:
        entity_features(cells, max_types=2)
        raise AssertionError("the limit must be an error")
    except ValueError:
        pass
    empty = event_cells(spark.createDataFrame([], EVENTS), "entity", "kind", "time")
    assert entity_features(empty, as_of=0.0).count() == 0 and entity_features(empty, layout="list").count() == 0


def brute_sessions(rows, gap):
    by = {}
    for e, _, _, t, _ in rows:
        if e is not None and t is not None:
            by.setdefault(e, []).append(t)
    out = []
    for e, ts in by.items():
        ts.sort()
        start = last = ts[0]
        n = 1
        for t in ts[1:]:
            if t - last > gap:
                out.append((e, start, last, n))
                start, n = t, 0
            last = t
            n += 1
        out.append((e, start, last, n))
    return sorted(out)


def test_sessions_do_not_depend_on_slots(small_batches):
    for seed in (3, 4):
        rows = made(seed)
        df = small_batches.createDataFrame(rows, EVENTS)
        for slot in (1800.0, 5000.0, 86400.0, 1e9):
            got = sorted((r["entity"], r["start"], r["end"], r["n"]) for r in sessions(df, "entity", "time", 1800.0, slot).collect())
            assert got == brute_sessions(rows, 1800.0), (seed, slot)


def test_sessions_long_chain_across_slots(small_batches):
    rows = [("a", "x", "c", 1700.0 * i, None) for i in range(200)] + [("a", "x", "c", 1700.0 * 199 + 1800.0, None)]
    got = sessions(small_batches.createDataFrame(rows, EVENTS), "entity", "time", 1800.0, 3600.0).collect()
    assert [(r["start"], r["end"], r["n"]) for r in got] == [(0.0, 1700.0 * 199 + 1800.0, 201)]


def test_sessions_exact_gap_beside_fractions(spark):
    """Pieces exactly the gap apart across a slot's edge stay one, whatever fractions other times in the batch have."""
    rows = [(f"e{i:04d}", 86400.0 * (i % 40 + 1) - 900.0) for i in range(800)]
    rows += [(e, t + 1800.0) for e, t in rows] + [(f"f{i:04d}", 86400.0 * (i % 40 + 1) - i / 7.0) for i in range(800)]
    df = spark.createDataFrame(rows + [("nan", float("nan")), ("inf", float("inf")), ("none", None)], "entity string, time double")
    for slot in (86400.0, 1e9):
        got = sessions(df, "entity", "time", 1800.0, slot).collect()
        assert len(got) == 1600 and all(r["n"] == 2 and r["duration"] == 1800.0 for r in got if r["entity"][0] == "e")


def test_sessions_empty(spark):
    assert sessions(spark.createDataFrame([], EVENTS), "entity", "time").count() == 0


def test_pack_is_even():
    placed, loads = pack([(7, "a"), (5, "b"), (4, "c"), (4, "d"), (2, "e")], 2)
    assert sorted(loads) == [11, 11] and len(placed) == 5


def test_balanced_counts_and_spreads(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abcdef"), f"r{rng.randrange(500)}", 1) for _ in range(3000)] + [(None, "r1", 1), ("a", None, 1)]
    df = spark.createDataFrame(rows, "author string, record string, _task int")
    plan = placement(df.where("author IS NOT NULL").groupBy(F.col("author").alias("key")).agg(F.count(F.lit(1)).alias("load")), tasks=8)
    assert len(plan.large["hot"]) > 1 and max(plan.loads) < 2 * sum(plan.loads) / 8
    got = {r["author"]: r["records"] for r in per_key(df, "author", "record", plan).collect()}
    want = {}
    for a, r, _ in rows:
        if a and r:
            want.setdefault(a, set()).add(r)
    assert got == {a: len(s) for a, s in want.items()}


def test_balanced_matching_side(spark):
    rows = spark.createDataFrame([("a", i, "l") for i in range(50)] + [("b", 50, "l"), ("z", 51, "l"), (None, 52, "l")], "author string, record int, side string")
    right = spark.createDataFrame([("a", "r1"), ("a", "r2"), ("b", "r3"), ("q", "r4")], "author string, side string")
    plan = placement(rows.where("author IS NOT NULL").groupBy(F.col("author").alias("key")).agg(F.count(F.lit(1)).alias("load")), tasks=4)
    inner = balanced(rows, "author", "record", plan, right)
    assert inner.count() == 101 and {"side", "side_right"} <= set(inner.columns)
    assert balanced(rows, "author", "record", plan, right, "left").count() == 103


def test_matching_side_keeps_the_placement(spark):
    """With broadcasts off, nothing but the placement by task number is exchanged, and a hot key's shards are even."""
    rng = random.Random(8)
    rows = spark.createDataFrame([("hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}", i) for i in range(4000)], "author string, record int")
    side = spark.createDataFrame([(a, j) for a in ("hot", *(f"k{i}" for i in range(40))) for j in range(2)], "author string, v int")
    plan = placement(rows.groupBy(F.col("author").alias("key")).agg(F.count(F.lit(1)).alias("load")), tasks=8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = balanced(rows, "author", "record", plan, side, "left").withColumn("part", F.spark_partition_id())
        loads = {r["part"]: r["count"] for r in joined.groupBy("part").count().collect()}
        text = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.count("shufflepartitionidpassthrough") >= 2 and "hashpartitioning" not in text and "BroadcastExchange" not in text
    assert sum(loads.values()) == 8000 and len(loads) == 8 and max(loads.values()) < 1.5 * 1000


def test_placement_of_nothing(spark):
    plan = placement(spark.createDataFrame([], "key string, load long"), tasks=4)
    assert plan.large == {} and sum(plan.loads) == 0


def test_one_per_id(spark):
    df = spark.createDataFrame([("1", None, 2), ("1", "a", 3), ("1", "b", None), (None, "c", 1), ("2", None, None)], "id string, x string, y int")
    assert {tuple(r) for r in one_per_id(df, x=F.col("x"), y=F.col("y")).collect()} == {("1", "a", 3), ("2", None, None)}
