"""Pairs made in blocks are those of all pairs, and no table of pairs is written on the way."""

import math
import os
import random

import numpy as np
import pytest

from tallyloom.operators import blocks as B
from tallyloom.operators import cooccurrence as C
from tests.test_operators import dense_cosine


def written(spark):
    """Bytes in the checkpoint folder."""
    at = (spark.sparkContext.getCheckpointDir() or "").removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(at) for f in files)


@pytest.mark.parametrize("full", [False, True])
@pytest.mark.parametrize(("part", "products", "bins"), [(16_384, 2_000_000, 100_000), (7, 9, 10)])
def test_alike_is_that_of_all_pairs(spark, monkeypatch, part, products, bins, full):
    monkeypatch.setattr(B, "PART", part)
    monkeypatch.setattr(B, "PRODUCTS", products)
    monkeypatch.setattr(B, "BINS", bins)
    rng = random.Random(7)
    rows = [(f"a{rng.randrange(30):02d}", f"t{min(rng.randrange(40), rng.randrange(40)):02d}") for _ in range(300)] + [(f"a{i:02d}", "all") for i in range(30)]
    names, s = dense_cosine(rows, 2, 0.9)
    i, j = np.triu_indices(len(names), 1)
    has = {}
    for a, t in rows:
        has.setdefault(a, set()).add(t)
    flat, square = np.round(s[i, j], 9), np.round(s.ravel(), 9)
    of = square if full else flat
    for percent in (30.0, 80.0):
        threshold = np.percentile(flat, percent)
        got = {(r["user_1"], r["user_2"]): r for r in C.alike(spark.createDataFrame(rows, "author string, token string"), 0, least_features=1, percent=percent, full_matrix=full).collect()}
        assert set(got) == {(names[p], names[q]) for p, q, v in zip(i, j, flat) if v > threshold}
        for p, q, v in zip(i, j, flat):
            if v > threshold:
                r, both = got[names[p], names[q]], sorted(has[names[p]] & has[names[q]])
                assert math.isclose(r["similarity"], v, abs_tol=1e-9) and math.isclose(r["threshold"], threshold, abs_tol=1e-9)
                assert r["shared"] == len(set(both) - {"all"}) and r["shared_tokens"] == "; ".join(both[:10])
                assert math.isclose(r["percentile_rank"], 50 * ((of < v).sum() + (of <= v).sum() + 1) / len(of), abs_tol=0.00501)


def test_communities_write_no_table_of_pairs(spark):
    """400 authors of two communities each make 79,800 pairs; a table of them took 345,196 bytes."""
    rows = [(f"a{i:03d}", t) for i in range(400) for t in (f"c{i % 3}", f"d{i % 5}")]
    tokens = spark.createDataFrame(rows, "author string, token string")
    C.alike(tokens, 0).count()  # the folder is there
    before = written(spark)
    assert C.alike(tokens, 0, full_matrix=True, percent=20.0).count() > 20_000
    assert written(spark) - before < 100_000


def test_threads_write_no_table_of_pairs(spark):
    """pairs that share a thread are few of all, so that the percentile is zero and all of them are given."""
    rows = [(f"a{i:03d}", f"t{(i * k) % 151:03d}") for i in range(600) for k in (1, 7)]
    tokens = spark.createDataFrame(rows, "author string, token string")
    C.alike(tokens, 0).count()  # the folder is there
    before = written(spark)
    found = C.alike(tokens, 0, percent=50.0).collect()
    assert written(spark) - before < 60_000
    has = {}
    for a, t in rows:
        has.setdefault(a, set()).add(t)
    want = {(a, b): "; ".join(sorted(has[a] & has[b])) for a in has for b in has if a < b and has[a] & has[b] and len(has[a]) > 1 and len(has[b]) > 1}
    assert {(r["user_1"], r["user_2"]): r["shared_tokens"] for r in found} == want and {r["threshold"] for r in found} == {0.0}


def test_character_pairs_join_no_pairs(spark):
    """pairs are found within blocks; joined by their grams, nearly all pairs of authors were shuffled."""
    from tallyloom.plans.catalogue import QUERIES

    plan = QUERIES["co_url_character_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInArrow" in plan and "Join" not in plan


@pytest.mark.parametrize("part", [None, 60])
def test_dense_blocks(spark, part):
    """Rows that share most tokens meet as matrix products."""
    rng = np.random.default_rng(3)
    x = rng.random((150, 20)) * (rng.random((150, 20)) > 0.2)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    weights = spark.createDataFrame([(f"a{i:03d}", f"g{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))], "author string, token string, w double")
    got = {(r["a"], r["b"]): (r["similarity"], r["shared"]) for r in B.Blocks(weights, part=part).pairs(0.8).collect()}
    s, both = x @ x.T, (x > 0).astype(int) @ (x > 0).astype(int).T
    assert set(got) == {(f"a{i:03d}", f"a{j:03d}") for i, j in zip(*np.nonzero(np.triu(s >= 0.8, 1)))} and len(got) > 100
    assert all(math.isclose(v, s[int(a[1:]), int(b[1:])], abs_tol=1e-12) and n == both[int(a[1:]), int(b[1:])] for (a, b), (v, n) in got.items())


@pytest.mark.parametrize("grams", [False, True])
def test_null_percentile_is_that_of_all_pairs_of_all_repeats(spark, grams):
    """the number of pairs of all repeats was taken for that of one collection, which left some out."""
    rng = random.Random(5)
    tokens = spark.createDataFrame([(f"a{rng.randrange(12):02d}", f"{rng.choice('pqrs')}{rng.randrange(9)}") for _ in range(60)], "author string, token string")
    mixed = C.permuted(tokens, 3)
    values = []
    for rep in (1, 2, 3):
        one = mixed.where(f"rep = {rep}").select("author", "token")
        weights = C.tfidf(C.char_grams(one) if grams else one).collect()
        names, words = (sorted({r[c] for r in weights}) for c in ("author", "token"))
        x = np.zeros((len(names), len(words)))
        for r in weights:
            x[names.index(r["author"]), words.index(r["token"])] = r["w"]
        values += np.round((x @ x.T)[np.triu_indices(len(names), 1)], 6 if grams else 9).tolist()
    for percent in (60.0, 99.0):
        assert math.isclose(C.null_percentile(tokens, 3, percent, grams=grams), np.percentile(values, percent), abs_tol=2e-9)
