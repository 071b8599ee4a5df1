"""Near copies against brute force."""

import random
import re

from tallyloom.llm import near_copies as N


def grams(text, k):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}, len(w)


def brute(rows, threshold, k, least):
    g = {}
    for name, t in rows:
        if name is not None and t is not None:
            s, n = grams(t, k)
            if n >= least:
                g[name] = s
    names = sorted(g)
    return {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if len(g[a] & g[b]) >= threshold * len(g[a] | g[b])}


def made(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([9, 10, 12, 30, 60]))]
        rows.append((f"t1_{i:04d}", " ".join(words)))
        for c in range(rng.choice([0, 0, 1, 3])):
            other = list(words)
            for _ in range(rng.choice([0, 1, 2])):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            rows.append((f"t3_{i:04d}_{c}", rng.choice([" ", "  \n", ", "]).join(other).upper()))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "name string, text string, class string, idx int").repartition(3)


def test_pairs_equal_brute_force(spark):
    rows = made(1) + [(None, "a b c d e f g h i j k"), ("t1_null", None), ("t1_blank", "  "), ("t1_few", "one two three")]
    links, members = N.near_copies(frame(spark, rows), "name", "text", 0.7, 3, 10)
    got = {tuple(r) for r in N.copy_pairs(links, members, None).collect()}
    want = brute(rows, 0.7, 3, 10)
    assert got <= want and len(got) >= 0.98 * len(want) and want
    # representatives and membership say the same: expanding them gives every pair
    for expand in (1, 2, 3):
        short = {tuple(r) for r in N.copy_pairs(links, members, expand).collect()}
        face = {r["name"]: r["class_name"] for r in N.copy_groups(links, members).collect()}
        linked = {(face[a], face[b]) for a, b in short}
        assert short <= got and {tuple(sorted((a, b))) for a in face for b in face if a < b and (face[a] == face[b] or (face[a], face[b]) in linked or (face[b], face[a]) in linked)} == got


def test_default_of_five_words_and_four_fifths(spark):
    rows = made(2)
    links, members = N.near_copies(frame(spark, rows), "name", "text")
    assert {tuple(r) for r in N.copy_pairs(links, members, None).collect()} >= {p for p in brute(rows, 0.85, 5, 10)}


def test_large_class_is_a_star_and_groups_hold(spark):
    text = " ".join(f"word{i}" for i in range(40))
    near = text + " tail"
    rows = [(f"n{i:03d}", text) for i in range(100)] + [("z1", near), ("other", " ".join(f"x{i}" for i in range(30)))]
    links, members = N.near_copies(frame(spark, rows), "name", "text", 0.5, 3, 10)
    pairs = {tuple(r) for r in N.copy_pairs(links, members).collect()}
    assert pairs == {("n000", f"n{i:03d}") for i in range(1, 100)} | {("n000", "z1")}
    groups = {r["name"]: (r["group_name"], r["n_links"]) for r in N.copy_groups(links, members).collect()}
    assert len(groups) == 102 and len({g for g, _ in groups.values()}) == 2 and groups["z1"][1] == 1 and groups["other"][1] == 0


def test_crowded_buckets_are_divided(spark, monkeypatch):
    monkeypatch.setattr(N, "RUN", 4)
    base = [f"word{i}" for i in range(60)]
    rows = [(f"n{i:02d}", " ".join(base + [f"end{i}"])) for i in range(30)]
    links, members = N.near_copies(frame(spark, rows), "name", "text", 0.5, 3, 10)
    assert links.count() == 30 * 29 // 2
    rows = made(5) + rows
    links, members = N.near_copies(frame(spark, rows), "name", "text", 0.5, 3, 10)
    got, want = {tuple(r) for r in N.copy_pairs(links, members, None).collect()}, brute(rows, 0.5, 3, 10)
    assert got <= want and len(got) >= 0.97 * len(want)


def test_one_long_text_and_nothing(spark):
    long = " ".join(f"w{i % 7919}" for i in range(120_000))
    links, members = N.near_copies(frame(spark, [("a", long), ("b", long + " x"), ("c", "")]), "name", "text")
    assert links.count() == 1 and members.count() == 2
    links, members = N.near_copies(frame(spark, []), "name", "text")
    assert links.count() == 0 and members.count() == 0 and N.copy_pairs(links, members).count() == 0


def test_repeated_name(spark):
    t = " ".join(f"q{i}" for i in range(12))
    links, members = N.near_copies(frame(spark, [("a", t), ("a", t), ("b", t)]), "name", "text")
    assert {tuple(r) for r in N.copy_pairs(links, members).collect()} == {("a", "b")}
