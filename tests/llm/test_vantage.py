"""Nearest vectors against brute force: exact with factor one, near enough with the factor in use."""

import numpy as np

from tallyloom.llm.vantage import nearest


def brute(ids, x, k, least):
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = y @ y.T
    out = {}
    for i in range(len(ids)):
        order = [j for j in np.lexsort((ids, -s[i])) if j != i and s[i, j] >= least][:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, dim))
    x = centres[rng.integers(0, len(centres), n)] + 0.25 * rng.standard_normal((n, dim))
    return np.arange(n) * 3 + 1, (x * rng.uniform(0.1, 9, (n, 1))).astype(np.float32)


def frame(spark, ids, x, extra=()):
    rows = [(int(i), [float(v) for v in r], 1, True) for i, r in zip(ids, x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, vec array<float>, shard int, home boolean").repartition(5)


def neighbours(df):
    out = {}
    for r in df.orderBy("vec_id", "similarity").collect():
        out.setdefault(r["vec_id"], []).append((-r["similarity"], r["neighbour"]))
    return {i: [n for _, n in sorted(v)] for i, v in out.items()}


def test_factor_one_is_exact(spark):
    ids, x = clustered(300, 12, 1)
    got = neighbours(nearest(frame(spark, ids, x), "vec_id", "vec", 5, 0.2, factor=1.0, shard_rows=80, leaf_rows=10, sample_rows=100))
    want = brute(ids, x.astype(np.float64), 5, 0.2)
    assert got == {i: n for i, n in want.items() if n}


def test_routing_by_levels(spark):
    """Every row reaches its own leaf; with a reach of all distances every leaf, with a budget no more than that."""
    from tallyloom.llm.vantage import _unit, grow, route

    _, x = clustered(400, 12, 5)
    y = _unit(x)
    tree = grow(y, 4, np.random.default_rng(0), 16, 256, 0.05)
    leaf_of = np.empty(400, int)
    for leaf, rows in enumerate(tree.members):
        leaf_of[rows] = leaf
    row, leaf, home = route(tree, y, 0.05)
    assert home.sum() == 400 and (leaf[home] == leaf_of[row[home]]).mean() > 0.99
    row, leaf, _ = route(tree, y, 9.0)
    assert len(row) == 400 * 16 and len(set(zip(row, leaf))) == len(row)
    row, leaf, home = route(tree, y, 9.0, visits=3)
    assert (np.bincount(row) == 3).all() and home.sum() == 400
    assert sum(map(len, tree.members)) == 400


def test_relaxed_factor_keeps_recall(spark):
    ids, x = clustered(1500, 40, 2)
    got = neighbours(nearest(frame(spark, ids, x), "vec_id", "vec", 10, 0.8, factor=0.15, shard_factor=0.07, shard_rows=400, leaf_rows=32))
    want = brute(ids, x.astype(np.float64), 10, 0.8)
    found = sum(len(set(got.get(i, [])) & set(n)) for i, n in want.items())
    assert found >= 0.95 * sum(map(len, want.values()))


def test_dirty_rows_queries_and_copies(spark):
    ids, x = clustered(60, 8, 3)
    copies = [(1000 + i, [1.0] * 8, 1, True) for i in range(40)]
    bad = [(None, [1.0] * 8, 1, True), (5000, None, 1, True), (5001, [0.0] * 8, 1, True), (5002, [1.0, 2.0], 1, True), (5003, [float("nan")] * 8, 1, True), (5004, [], 1, True), (5005, [None] * 8, 1, True)]
    repeated = [(int(ids[0]), [float(v) for v in x[0]], 1, True)]
    df = frame(spark, ids, x, copies + bad + repeated)
    got = neighbours(nearest(df, "vec_id", "vec", 10, 0.9, factor=1.0))
    assert all(got[1000 + i] == [1000 + j for j in range(11) if j != i][:10] for i in range(40))
    assert not {5000, 5001, 5002, 5003, 5004, 5005} & set(got)
    some = nearest(df, "vec_id", "vec", 3, -1.0, factor=1.0, queries=df["vec_id"] % 50 == 0)
    asked = {r["vec_id"] for r in some.select("vec_id").distinct().collect()}
    assert asked == {i for i in [*map(int, ids), *range(1000, 1040)] if i % 50 == 0}
    assert some.count() == 3 * len(asked)


def test_many_equal_bad_vectors(spark):
    """More ids than k + 1 with one and the same vector that takes no part: none of them gets or is a neighbour."""
    ids, x = clustered(60, 8, 3)
    kinds = [[0.0] * 8, [], [1.0, 2.0], [float("nan")] * 8, [float("inf")] * 8, [None] * 8]
    bad = [(1000 * (j + 1) + i, v, 1, True) for j, v in enumerate(kinds) for i in range(40 if j != 2 else 100)]
    both = [(int(ids[0]), [0.0] * 8, 1, True), (int(ids[1]), [3.0], 1, True)]
    got = neighbours(nearest(frame(spark, ids, x, bad + both), "vec_id", "vec", 10, 0.5, factor=1.0))
    assert got == {i: n for i, n in brute(ids, x.astype(np.float64), 10, 0.5).items() if n}


def test_nothing(spark):
    for rows in ([], [(1, None)], [(1, [0.0])]):
        assert nearest(spark.createDataFrame(rows, "vec_id long, vec array<float>"), "vec_id", "vec").count() == 0
    assert nearest(spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, vec array<float>"), "vec_id", "vec").count() == 0
