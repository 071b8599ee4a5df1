"""Timing, co-occurrence, similarity, labels and training against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import content as K
from tallyloom.operators import cooccurrence as C
from tallyloom.operators import features as G
from tallyloom.operators import labels as L
from tallyloom.operators import relational as J
from tallyloom.operators import similarity as V
from tallyloom.operators import timing as T
from tallyloom.operators import training as M

COMMENT = "id string, author string, parent string, thread string, subreddit string, created_utc double"


def thread(seed, n=120):
    rng = random.Random(seed)
    rows = [(f"c{i:03d}", rng.choice(["a", "b", "c", None]), rng.choice(["p", "q", f"c{rng.randrange(n):03d}", None]), rng.choice(["p", "q", None]), "s", rng.choice([None, round(rng.uniform(0, 400), 1), 100.0])) for i in range(n)]
    return rows


@pytest.mark.parametrize("seconds", [0, 3, 10])
def test_siblings(spark, seconds):
    rows = thread(1)
    want = set()
    for a in rows:
        for b in rows:
            if None not in (a[1], b[1], a[2], b[2], a[5], b[5]) and a[2] == b[2] and a[1] != b[1] and (a[5], a[0]) < (b[5], b[0]) and int(b[5] - a[5]) <= seconds:
                want.add((a[0], b[0], int(b[5] - a[5])))
    got = {(r["id_a"], r["id_b"], r["delta_seconds"]) for r in T.sibling_replies(spark.createDataFrame(rows, COMMENT), seconds).collect()}
    assert got == want and (seconds == 0 or want)


@pytest.mark.parametrize("slot", [25.0, 86400.0])
def test_adjacent_and_direct(spark, slot):
    rows = thread(2)
    good = [r for r in rows if r[1] and r[3] and r[5] is not None]
    want = set()
    for t in ("p", "q"):
        line = sorted((r for r in good if r[3] == t), key=lambda r: (r[5], r[0]))
        want |= {(x[0], y[0]) for x, y in zip(line, line[1:]) if x[1] != y[1] and int(y[5] - x[5]) <= 10}
    df = spark.createDataFrame(rows, COMMENT)
    got = T.adjacent_responses(df, "thread", 10, slot)
    assert {(r["previous_comment_id"], r["responder_comment_id"]) for r in got.collect()} == want
    by = {r[0]: r for r in rows}
    direct = {(r[2], r[0]) for r in rows if r[2] in by and r[1] and by[r[2]][1] and r[1] != by[r[2]][1] and r[5] is not None and by[r[2]][5] is not None and 0 <= int(r[5] - by[r[2]][5]) <= 50}
    assert {(r["parent_comment_id"], r["child_comment_id"]) for r in T.direct_replies(df, 50).collect()} == direct


def test_parent_types(spark):
    df = spark.createDataFrame([("t1_a",), ("t3_b",), ("x",), (None,)], "p string")
    assert [tuple(r) for r in df.select(T.bare_id("p"), T.parent_type("p"), T.parent_type("p", True)).collect()] == [("a", "comment", "comment"), ("b", "post", "post"), ("x", "post", None), (None, None, None)]


def dense_cosine(rows, least_df, most_df):
    authors, tokens = sorted({a for a, _ in rows}), sorted({t for _, t in rows})
    x = np.zeros((len(authors), len(tokens)))
    for a, t in rows:
        x[authors.index(a), tokens.index(t)] += 1
    df = (x > 0).sum(0)
    keep = (df >= least_df) & (df <= most_df * len(authors))
    x = x[:, keep] * (np.log((1 + len(authors)) / (1 + df[keep])) + 1)
    x = x[x.any(1)]
    names = [a for a, r in zip(authors, range(len(authors))) if True]
    names = [a for a in authors if any(t in np.array(tokens)[keep] for b, t in rows if b == a)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return names, x @ x.T


def test_cosine_threshold_and_ranks(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 3)
    rng = random.Random(4)
    rows = [(f"a{rng.randrange(25):02d}", f"t{min(rng.randrange(30), rng.randrange(30)):02d}") for _ in range(300)]
    names, s = dense_cosine(rows, 2, 0.9)
    i, j = np.triu_indices(len(names), 1)
    tokens = spark.createDataFrame(rows, "author string, token string")
    weights = C.tfidf(tokens, 2, 0.9)
    got = {(r["a"], r["b"]): r["similarity"] for r in C.shared_cosine(weights).collect()}
    assert all(math.isclose(got.get((names[p], names[q]), 0.0), s[p, q], abs_tol=1e-9) for p, q in zip(i, j))
    high = {(r["a"], r["b"]) for r in C.shared_cosine(weights, 0.5).collect()}
    assert high == {(names[p], names[q]) for p, q in zip(i, j) if s[p, q] >= 0.5 - 1e-12}
    for percent in (10.0, 60.0, 99.0, 100.0):
        assert math.isclose(C.pairs_percentile(C.shared_cosine(weights), len(names), percent), np.percentile(np.round(s[i, j], 12), percent), abs_tol=1e-9)
    pairs = C.shared_cosine(weights).withColumn("similarity", F.round("similarity", 9))
    flat = np.round(s[i, j], 9)
    for r in C.percentile_rank(pairs, len(names)).collect():
        lower, upto = (flat < r["similarity"]).sum(), (flat <= r["similarity"]).sum()
        assert math.isclose(r["percentile_rank"], 50 * (lower + upto + 1) / len(flat), rel_tol=1e-9)


def test_permuted_tokens_keep_counts(spark):
    rows = [("a", "x")] * 3 + [("b", "y")] * 2 + [("c", "z")]
    got = C.permuted(spark.createDataFrame(rows, "author string, token string"), 4).collect()
    for rep in range(1, 5):
        mine = [r for r in got if r["rep"] == rep]
        assert sorted(r["token"] for r in mine) == sorted(t for _, t in rows) and sorted(r["author"] for r in mine) == sorted(a for a, _ in rows)


def vectors(n=80, dim=10, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n // 4, dim))[rng.integers(0, n // 4, n)] + 0.2 * rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_dense_search(spark):
    x = vectors()
    df = V.unit(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 10), (902, [])], "k long, e array<double>"), "k", "e")
    s = x @ x.T
    want = {(a, b) for a in range(80) for b in range(a + 1, 80) if s[a, b] >= 0.8}
    pairs = V.range_pairs(df, 0.8, block=17)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want
    signs = V.signatures(df, 10, 4, 6)
    ranged = V.bucket_pairs(df, signs, 0.8, split=5)
    found, top = {(r["a"], r["b"]) for r in ranged.collect()}, {(r["a"], r["b"]) for r in V.bucket_pairs(df, signs, 0.8, top_k=2).collect()}
    assert top <= found <= want and len(found) > 0.6 * len(want)
    r = V.recall_precision(pairs, ranged).first()
    assert math.isclose(r["recall"], len(found) / len(want)) and r["precision"] == 1.0
    assert V.recall_precision(pairs.limit(0), pairs.limit(0)).first()["precision"] == 1.0
    near = V.hamming_pairs(df, V.signatures(df, 10, 32, 1), 0.8, 5).collect()
    assert all(s[r["query"], r["id"]] >= 0.8 - 1e-9 for r in near) and near
    assert 0.0 < V.sampled_threshold(df, 2000, 0.99) <= 1.0


def test_neighbouring_buckets(spark):
    """Exactly the pairs whose signatures differ in at most one bit of some table, in one part and in several."""
    x = vectors()
    df = V.unit(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k long, e array<double>"), "k", "e")
    s = x @ x.T
    signs = V.signatures(df, 10, 7, 2)
    by = {(r["table"], r["id"]): r["signature"] for r in signs.collect()}
    want = {(a, b) for a in range(80) for b in range(a + 1, 80) if s[a, b] >= 0.5 and any((by[t, a] ^ by[t, b]).bit_count() <= 1 for t in range(2))}
    for block in (4096, 5):
        got = V.probed_pairs(df, signs, 7, 0.5, block=block).collect()
        assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want
        assert all(math.isclose(r["similarity"], s[r["a"], r["b"]]) for r in got)
    top = {(r["a"], r["b"]) for r in V.probed_pairs(df, signs, 7, 0.5, top_k=1).collect()}
    assert top < want and {i for p in top for i in p} == {i for p in want for i in p}


def test_registered_search_finds_nine_tenths(spark):
    from tallyloom.plans import similarity_queries as Q

    rows = {(r["flips"], r["top_k"]): r for r in Q.lsh_recall(spark, "/root/testdata/sf0.01").where("bits = 12 AND tables = 4").collect()}
    assert min(rows[1, None]["recall"], rows[1, 40]["recall"]) >= 0.9 and rows[1, None]["precision"] == 1.0
    pairs = Q.lsh_range_pairs(spark, "/root/testdata/sf0.01")
    assert pairs.count() == rows[1, None]["n_found"]


def test_density_clusters(spark):
    ids = spark.range(12).withColumnRenamed("id", "id")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3), (5, 6), (6, 7), (5, 7), (7, 8), (3, 8), (9, 10)], "a long, b long")
    got = {r["id"]: r["label"] for r in V.density_clusters(ids, pairs, 3).collect()}
    degree = {0: 3, 1: 3, 2: 4, 3: 3, 5: 3, 6: 3, 7: 4, 8: 3}
    assert all(got[i] == 0 for i in degree) and all(got[i] == -1 for i in (4, 9, 10, 11))
    border = {r["id"]: r["label"] for r in V.density_clusters(ids, spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3), (5, 6), (6, 7), (5, 7), (7, 3)], "a long, b long"), 4).collect()}
    assert border[2] == 0 and border[7] == 1 and border[3] == 0 and border[0] == 0 and border[5] == 1


def test_pooled_chunks_and_encoder(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "d"), (2, "e f")], "id long, text string")
    got = V.pooled_chunks(V.embed(df, "text", V.hashed_words(8)).select("id", "v")).collect()
    assert len(got) == 2 and all(math.isclose(sum(v * v for v in r["v"]), 1.0) for r in got)


def test_duplicates_topics(spark):
    posts = spark.createDataFrame([("1", "a", "x  y"), ("2", "b", "x y"), ("3", "a", "x y"), ("4", "a", "z"), ("5", "a", "z"), ("6", None, "x y")], "id string, author string, text string")
    assert [tuple(r) for r in K.duplicate_texts(posts).collect()] == [("x y", 2, 3, "1")]
    topics = K.cluster_topics(spark.createDataFrame([(1, "p")] * 3 + [(1, "q")] * 2 + [(2, "q")], "cluster int, topic string"))
    assert {(r["cluster"], r["topics"]) for r in K.topic_line(topics).collect()} == {(1, "p (3), q (2)"), (2, "q (1)")}


def test_reply_modes_and_activity(spark):
    c = spark.createDataFrame([("a", "x", 10.0), ("a", "x", 40.0), ("a", "y", 5.0), ("a", "gone", 9.0)], "author string, parent string, created_utc double")
    parents = spark.createDataFrame([("x", 4.0), ("y", 7.0)], "id string, created_utc double")
    last = G.reply_times(c, parents).first()
    every = G.reply_times(c, parents, "per_reply").first()
    assert last["mean_reply_time_seconds"] == 36.0 and every["mean_reply_time_seconds"] == 21.0
    assert math.isclose(last["reply_time_coverage"], 1 / 3) and every["reply_time_coverage"] == 0.5
    both = G.activity(spark.createDataFrame([("a", 0.0), ("a", 86400.0), ("b", None)], "author string, created_utc double"), spark.createDataFrame([("a", 86400.0 * 3)], "author string, created_utc double"))
    got = {r["author"]: r for r in both.collect()}
    assert got["a"]["account_age_days"] == 2.0 and got["a"]["comments_per_day"] == 1.0 and got["b"]["account_age_days"] == 0.0


def brute_entropy(x):
    x = sorted(x)
    n = len(x)
    m = math.floor(math.sqrt(n) + 0.5)
    gap = [x[min(i + m, n - 1)] - x[max(i - m, 0)] for i in range(n)]
    return sum(math.log(n / (2 * m) * g) if g > 0 else float("-inf") for g in gap) / n


def test_statistics_of_large_samples(spark, monkeypatch):
    """Samples beyond what one row may hold are ranked by ranges; ties, hot values and nulls."""
    monkeypatch.setattr(G, "GATHERED", 1000)
    rng = random.Random(2)
    rows = [("hot", rng.expovariate(1.0)) for _ in range(3000)] + [("ties", float(rng.randrange(400))) for _ in range(1500)] + [("flat", 7.0 if i % 3 else float(i)) for i in range(1200)] + [("few", float(i * i)) for i in range(30)] + [("none", None)]
    got = {r["k"]: r for r in G.sample_statistics(spark.createDataFrame(rows, "k string, x double").repartition(7), ("k",), "x").collect()}
    by = {}
    for k, v in rows:
        by.setdefault(k, []).append(v)
    for k in ("hot", "ties"):
        assert math.isclose(got[k]["entropy"], brute_entropy(by[k]), rel_tol=1e-9), k
        assert math.isclose(got[k]["mean"], float(np.mean(by[k])), rel_tol=1e-9) and math.isclose(got[k]["variance"], float(np.var(by[k], ddof=1)), rel_tol=1e-9)
    assert got["flat"]["entropy"] == float("-inf") and got["few"]["entropy"] is not None and got["none"]["mean"] is None and got["none"]["entropy"] is None


def test_gaps_do_not_depend_on_slots(spark):
    rng = random.Random(3)
    rows = [("a" if rng.random() < 0.7 else "b", rng.choice([0.0, None, 5.0, 5.0, rng.uniform(1, 9e5)])) for _ in range(400)]
    df = spark.createDataFrame(rows, "author string, created_utc double")
    want = {}
    for a, t in rows:
        if t:
            want.setdefault(a, []).append(t)
    want = {a: sorted(y - x for x, y in zip(sorted(t), sorted(t)[1:])) for a, t in want.items()}
    for slot in (50.0, 86400.0, 1e9):
        got = {}
        for r in G.gaps(df, slot=slot).collect():
            got.setdefault(r["author"], []).append(r["gap"])
        assert {a: sorted(g) for a, g in got.items()} == want, slot


def test_hamming_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    x = vectors(120, 10, 6)
    x[60:90] = x[5]  # one signature for a quarter of all rows
    df = V.unit(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k long, e array<double>"), "k", "e")
    signs = V.signatures(df, 10, 16, 1)
    sig = {r["id"]: r["signature"] for r in signs.collect()}
    for k in (3, 40, 500):
        want = set()
        for q in range(0, 120, 7):
            near = sorted((i for i in sig if i != q), key=lambda i: ((sig[q] ^ sig[i]).bit_count(), i))[:k]
            want |= {(q, i) for i in near if x[q] @ x[i] >= 0.3}
        got = {(r["query"], r["id"]) for r in V.hamming_pairs(df, signs, 0.3, k, F.col("id") % 7 == 0, bits=16, blocks=4).collect()}
        assert got == want, k


def test_first_by_keeps_every_key(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "2020", None), ("a", "2021", 5), ("b", None, None), ("c", "x", 2), ("c", "x", 1), (None, "x", 1)], "id string, p string, s int")
    assert {tuple(r) for r in J.first_by(df, "id", ["p", "s"]).collect()} == {("a", "2020", None), ("b", None, None), ("c", "x", 1)}
    assert {tuple(r) for r in J.first_by(df, "id", ["p", "s"], last=True).collect()} == {("a", "2021", 5), ("b", None, None), ("c", "x", 2)}


def test_labels(spark):
    stats = spark.createDataFrame([("news-bot", 9), ("Ann", 5), ("few", 1), ("boots", 5)], "author string, total_posts int")
    ranked = spark.createDataFrame([("ANN", 0.95), ("ann", 0.2)], "author string, score double")
    got = {r["author"]: (r["label"], r["label_source"], r["y"]) for r in L.assign_labels(stats, ranked).collect()}
    assert got == {"news-bot": ("bot", "rule", 1), "Ann": ("bot", "botrank", 1), "boots": ("human", "rule", 0)}
    w = spark.range(1).select(L.wilson(F.lit(5), F.lit(20)).alias("w"), L.wilson(F.lit(0), F.lit(0)).alias("z")).first()
    assert math.isclose(w["w"]["low"], 0.1118, abs_tol=1e-3) and math.isclose(w["w"]["high"], 0.4687, abs_tol=1e-3) and w["z"] is None
    changes = L.compare_lists(spark.createDataFrame([("a",), ("b",)], "author string"), spark.createDataFrame([("b",), ("c",)], "author string"))
    assert {tuple(r) for r in changes.collect()} == {("a", "eliminated"), ("b", "kept"), ("c", "added")}


def test_samples_and_sets(spark):
    rows = spark.range(500).withColumn("g", F.when(F.col("id") < 450, 1).otherwise(F.col("id") % 3))
    assert J.hash_sample(rows, "id", 20).count() == 20 and J.hash_sample(rows.repartition(9), "id", 20).exceptAll(J.hash_sample(rows, "id", 20)).count() == 0
    assert max(r["count"] for r in J.quota_sample(rows, "g", "id", 30).groupBy("g").count().collect()) == 10
    assert J.bernoulli_sample(rows, "id", 0.5, 40).count() == 40
    assert J.first_by(spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("j", 1, None)], "k string, o int, v string"), "k", ["o"]).count() == 2


def test_training(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 3))
    y = (x[:, 0] + 0.3 * rng.standard_normal(300) > 0.5).astype(int)
    rows = spark.createDataFrame([(f"u{i}", int(y[i]), float(x[i, 0]) if i % 17 else None, float(x[i, 1]) if i % 31 else float("inf"), float(x[i, 2])) for i in range(300)], "author string, y int, f0 double, f1 double, f2 double")
    columns = ["f0", "f1", "f2"]
    split = M.stratified_split(M.clip(rows, columns))
    n = {(r["y"], r["split"]): r["count"] for r in split.groupBy("y", "split").count().collect()}
    assert sum(n.values()) == 300 and abs(n[0, "train"] / sum(v for (k, _), v in n.items() if k == 0) - 0.7) < 0.02
    fit = F.col("split") == "train"
    ready = M.standardize(M.impute(split, columns, fit), columns, fit).cache()
    s = ready.where(fit).agg(F.avg("f0"), F.stddev_pop("f0")).first()
    assert abs(s[0]) < 1e-9 and abs(s[1] - 1) < 1e-9
    model, scored = M.train(ready, columns, M.models(3, rounds=5)["forest"])
    m = M.metrics(scored.where("split = 'test'"), 0.5).first()
    t = scored.where("split = 'test'").toPandas()
    pos, neg = t.score[t.y == 1].to_numpy(), t.score[t.y == 0].to_numpy()
    auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert math.isclose(m["roc_auc"], auc, rel_tol=1e-9) and m["roc_auc"] > 0.8
    assert M.best_threshold(M.threshold_sweep(scored), 2.0) == 0.5
    importance = {r["feature"]: r["importance"] for r in M.permutation_importance(ready.where("split = 'test'").drop("split"), columns, model, 1).collect()}
    assert importance["f0"] > importance["f2"]
    balanced = M.balanced_split(rows, 50).groupBy("split", "y").count().collect()
    train = {r["y"]: r["count"] for r in balanced if r["split"] == "train"}
    assert train[0] == train[1] == 50
    assert M.pseudo_labels(scored, scored.where("split = 'test'"), 0.6).count() > 0


def test_streams_equal_batch(spark, tmp_path):
    from tallyloom.operators.sessions import sessions
    from tallyloom.streaming.replies import stream_adjacent, stream_direct_replies, stream_sessions

    rng = random.Random(9)
    rows = sorted(((f"c{i:03d}", rng.choice("abc"), f"c{rng.randrange(max(i, 1)):03d}", rng.choice("pq"), "s", 1000.0 + 40 * i + rng.randrange(30)) for i in range(150)), key=lambda r: r[5])
    late = [("end", "zz", None, "zz", "s", 9e8)]  # moves the watermark past all others
    spark.createDataFrame(rows, COMMENT).coalesce(1).write.parquet(str(tmp_path / "in/1"))
    spark.createDataFrame(late, COMMENT).coalesce(1).write.parquet(str(tmp_path / "in/2"))
    schema = spark.createDataFrame([], COMMENT).schema

    def run(make, name):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        done = q.awaitTermination(90)
        q.stop()
        assert done, name
        return spark.table(name).collect()

    batch = spark.createDataFrame(rows, COMMENT)
    direct = {(r["parent_comment_id"], r["child_comment_id"]) for r in T.direct_replies(batch, 300).collect()}
    assert {(r["parent_comment_id"], r["child_comment_id"]) for r in run(lambda s: stream_direct_replies(s, 300), "direct")} == direct and direct
    closed = {(r["author"], r["start_utc"], r["end_utc"], r["n"]) for r in run(lambda s: stream_sessions(s, 120, "1 hour"), "sess")}
    assert closed == {(r["entity"], int(r["start"]), int(r["end"]), r["n"]) for r in sessions(batch, "author", "created_utc", 120.0).collect()}
    near = sorted((r["thread"], r["previous_author"], r["author"], r["delta_seconds"]) for r in run(lambda s: stream_adjacent(s, 100), "adj"))
    assert near == sorted((r["thread_id"], r["previous_author"], r["responder_author"], r["delta_seconds"]) for r in T.adjacent_responses(batch, "thread", 100).collect())


def test_character_grams_equal_the_text(spark):
    rng = random.Random(9)
    rows = [(rng.choice("abc"), rng.choice(["x.example", "Y.test", "é", "a  b", "xx", "x"])) for _ in range(60)] + [("only", "q"), (None, "x"), ("a", None)]
    got = {}
    for r in C.char_grams(spark.createDataFrame(rows, "author string, token string")).collect():
        got.setdefault(r["author"], []).append(r["token"])
    for who in {a for a, t in rows if a and t}:
        text = " ".join(sorted(t.lower().replace("  ", " ") for a, t in rows if a == who and t))
        assert sorted(got[who]) == sorted([*text, *(text[i : i + 2] for i in range(len(text) - 1))]), who


def test_sampled_thresholds_and_shared_tokens(spark):
    rng = random.Random(4)
    rows = [(f"a{rng.randrange(25):02d}", f"t{min(rng.randrange(30), rng.randrange(30)):02d}") for _ in range(300)]
    tokens = spark.createDataFrame(rows, "author string, token string")
    weights = C.tfidf(tokens, 2, 0.9).cache()
    names, s = dense_cosine(rows, 2, 0.9)
    flat = np.round(s[np.triu_indices(len(names), 1)], 9)
    for percent in (50.0, 99.0):  # a sample of all pairs is all pairs
        assert math.isclose(C.sampled_percentile(weights, 10_000, percent), np.percentile(flat, percent), abs_tol=1e-9)
    some = C.sampled_percentile(weights, 60, 90.0)
    assert flat.min() <= some <= flat.max() and C.sampled_percentile(weights.limit(0), 10, 99.0) == 0.0
    found = C.alike(tokens, 0, sample=10_000, percent=90.0).collect()
    assert {(r["user_1"], r["user_2"]) for r in found} == {(names[i], names[j]) for i, j in zip(*np.triu_indices(len(names), 1)) if round(s[i, j], 9) > np.percentile(flat, 90.0)}
    has = {}
    for a, t in rows:
        has.setdefault(a, set()).add(t)
    pairs = spark.createDataFrame([("a01", "a02"), ("a03", "a04")], "user_1 string, user_2 string")
    for r in C.shared_tokens(pairs, tokens, "user_1", "user_2", 2, "; ").collect():
        assert (r["shared_tokens"] or "") == "; ".join(sorted(has[r["user_1"]] & has[r["user_2"]])[:2])


def test_null_model_by_characters(spark):
    """The levels of dense_levels() are those of all pairs, in one block and in several."""
    rng = np.random.default_rng(1)
    rows = [(r, f"u{i}", f"g{j}", float(w)) for r in (1, 2) for i in range(9) for j, w in enumerate(rng.random(5)) if w > 0.2]
    df = spark.createDataFrame(rows, "rep int, author string, token string, w double")
    want = []
    for r in (1, 2):
        x = np.zeros((9, 5))
        for k, a, t, w in rows:
            if k == r:
                x[int(a[1:]), int(t[1:])] = w
        want += np.round((x @ x.T)[np.triu_indices(9, 1)], 6).tolist()
    for block in (512, 4):
        levels = C.dense_levels(df, "rep", block).collect()
        assert sorted(v for r in levels for v in [r["similarity"]] * r["n"]) == sorted(want)
    assert math.isclose(C.levels_percentile(C.dense_levels(df, "rep"), 37.0), np.percentile(want, 37.0), abs_tol=1e-6)
    assert C.levels_percentile(spark.createDataFrame([], "similarity double, n long"), 50.0) == 0.0


def test_listing_labeled_pairs_and_names(spark):
    from tallyloom.functions import text as X

    rows = spark.createDataFrame([(i, 0 if i < 6 else 1 if i < 14 else -1, f"text  {i}") for i in range(30)] + [(99, 2, None)], "id int, label int, text string")
    got = K.cluster_listing(rows, 5, 2).orderBy("place", "k").collect()
    assert [(r["place"], r["label"], r["size"], r["id"], r["text"]) for r in got] == [(1, 1, 8, 6, "text 6"), (1, 1, 8, 7, "text 7"), (2, 0, 6, 0, "text 0"), (2, 0, 6, 1, "text 1")]
    pairs = spark.createDataFrame([("p", "a", "b", 1), ("q", "a", "a", 0), ("r", "a", "gone", 1), ("s", None, "a", 0)], "pair_id string, text_a string, text_b string, label int")
    assert {r[0] for r in V.unique_texts(pairs).collect()} == {"a", "b", "gone"}
    vectors_ = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8])], "text string, v array<double>")
    assert {r["pair_id"]: r["similarity"] for r in V.score_pairs(pairs, vectors_).collect()} == {"p": 0.6, "q": 1.0}
    names = spark.createDataFrame([("NewsBot", "r/Cats", "t5_1"), ("ann", None, "T5_2 "), ("[deleted]", "dogs", None), (None, "", "x")], "a string, s string, i string")
    kept = names.select(X.without_parts("a", ("BOT", " ", "delet"), ("[deleted]",)).alias("k"), X.matched_community(["cats", "t5_2"], "s", "i").alias("m")).collect()
    assert [(r["k"], r["m"]) for r in kept] == [(False, "cats"), (True, "t5_2"), (True, None), (None, None)] and X.whole_numbers("8, 16,,32 ") == [8, 16, 32]
