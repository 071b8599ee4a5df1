"""Seed-tree groups, star components and term scores against plain Python."""

import math
import random

from tallyloom.llm.distinctive import term_distinctiveness
from tallyloom.llm.seed_tree import group_matches
from tallyloom.operators.components import components


def union_find(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def graphs():
    rng = random.Random(1)
    yield [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(60)]  # a chain
    yield [(f"n{rng.randrange(60):03d}", f"m{i:03d}") for i in range(40)] + [("hub", f"s{i}") for i in range(50)]
    yield [(str(rng.randrange(80)), str(rng.randrange(80))) for _ in range(60)]
    order = list(range(50))
    rng.shuffle(order)
    yield [(f"é{a}", f"é{b}") for a, b in zip(order, order[1:])]  # a chain in random order


def test_groups_equal_union_find(spark):
    for pairs in graphs():
        shown = pairs + [(b, a) for a, b in pairs[:5]] + pairs[:3]
        df = spark.createDataFrame([(a, b, "u") for a, b in shown] + [(None, "x", "u"), ("y", None, "u"), ("lone", "lone", "u")], "a string, b string, u string")
        want = union_find([(a, b) for a, b in pairs if a != b])
        assert {r["node"]: r["group"] for r in group_matches(df, "a", "b").collect()} == want
        star = {r["node"]: r["component"] for r in components(df, "a", "b").collect()}
        assert star == want | {"lone": "lone"} | {a: a for a, b in pairs if a == b and a not in want}


def test_groups_of_nothing(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert group_matches(df, "a", "b").count() == 0 and components(df, "a", "b").count() == 0


def test_numbers_as_nodes(spark):
    df = spark.createDataFrame([(10, 9), (9, 2), (30, 40)], "a long, b long")
    assert {tuple(r) for r in group_matches(df, "a", "b").collect()} == {(10, 2), (9, 2), (2, 2), (30, 30), (40, 30)}


def test_likelihood_ratio(spark):
    rows = [("r1", "x")] * 8 + [("r1", "y")] * 2 + [("r2", "y")] * 9 + [("r2", "x")] + [("r3", "z"), (None, "x"), ("r1", None)]
    got = {(r["record"], r["term"]): r for r in term_distinctiveness(spark.createDataFrame(rows, "record string, term string"), "record", "term").collect()}
    k = (8, 2, 1, 10)
    total, r1, x = 21, 10, 9
    expected = [x * r1 / total, (total - x) * r1 / total, x * (total - r1) / total, (total - x) * (total - r1) / total]
    g = 2 * sum(a * math.log(a / e) for a, e in zip(k, expected))
    assert math.isclose(got["r1", "x"]["llr"], g) and got["r1", "y"]["llr"] < 0
    assert math.isclose(got["r1", "x"]["weight"], 0.8 * math.log(3 / 2))
    assert len(got) == 5


def test_terms_of_one_record_and_none(spark):
    one = term_distinctiveness(spark.createDataFrame([("a", "t"), ("a", "u")], "record string, term string"), "record", "term").collect()
    assert all(abs(r["llr"]) < 1e-12 and r["weight"] == 0 for r in one)
    assert term_distinctiveness(spark.createDataFrame([], "record string, term string"), "record", "term").count() == 0
