"""Tokens, packing, mixing and text quality."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import quality as Q
from tallyloom.llm.mixing import leaves_of, mixture, plant, share_out
from tallyloom.llm.packing import fill, filling, fullest, pack
from tallyloom.llm.tokens import CHUNK, count_tokens, encoder, with_tokens


def test_tokens_of_long_text_equal_the_whole(spark):
    text = " ".join(f"word{i % 977} and,  more\n" for i in range(30_000))
    assert len(text) > 2 * CHUNK and count_tokens(text) == len(encoder("/opt/tokenizers/byte_bpe_multi_50k.tiktoken").encode_ordinary(text))
    df = spark.createDataFrame([(1, "hello there"), (2, None), (3, "")], "doc_id int, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in with_tokens(df, "text").collect()}
    assert got[1] == count_tokens("hello there") > 0 and got[2] is None and got[3] == 0


@pytest.mark.parametrize("part", ["\u6c34\u706b", "QUJD+/9", "line\n", "a\n\n\n  b", "x\x1c!\x1d?", "don't\t", "\u0e01\u0e02", "9 ", "\u00a0\u3000y ", "   "])
def test_tokens_of_any_long_text_equal_the_whole(part, monkeypatch):
    from tallyloom.llm import tokens

    monkeypatch.setattr(tokens, "CHUNK", 50)
    rng = random.Random(len(part))
    text = "".join(part if rng.random() < 0.9 else rng.choice(["z", " ", "\n", "'s", "\r\n ", "!"]) for _ in range(700))
    assert count_tokens(text) == len(encoder("/opt/tokenizers/byte_bpe_multi_50k.tiktoken").encode_ordinary(text))


def best_sum(items, room):
    reach = {0}
    for i in items:
        reach |= {r + i for r in reach if r + i <= room}
    return max(reach)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=14), st.integers(0, 80))
def test_fullest_is_best(items, room):
    counts = {n: items.count(n) for n in items}
    used = fullest(counts, sorted(counts, reverse=True), room)
    assert sum(used) == best_sum(items, room) and all(used.count(n) <= counts[n] for n in used)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(50, 90))
def test_fill_uses_each_once(items, capacity):
    out = []
    for combination, times in fill(items, capacity):
        assert sum(combination) <= capacity and times >= 1
        out += combination * times
    assert sorted(out) == sorted(items)


def test_pack_whole(spark):
    rng = random.Random(1)
    sizes = [(i, rng.choice([0, None, 1, 7, 90, 100, 101, 200, 555])) for i in range(500)] + [(None, 5), (0, 7)]
    items = spark.createDataFrame([(k, n, 3, "x") for k, n in sizes], "doc_id long, size long, container int, shard string")
    limits = spark.createDataFrame([(1, 100), (2, 256), (2, 256), (3, None), (4, 0)], "capacity_id int, capacity_tokens int")
    got = pack(items, "doc_id", "size", limits, shard_items=120).collect()
    for c, capacity in ((1, 100), (2, 256)):
        rows = [r for r in got if r["capacity_id"] == c]
        room = {}
        for r in rows:
            room[r["container"]] = room.get(r["container"], 0) + r["size"]
        assert max(room.values()) <= capacity
        total = {}
        for r in rows:
            total.setdefault(r["doc_id"], []).append(r)
        for k in {k for k, n in sizes if k is not None and n}:
            want = sorted(n for j, n in sizes if j == k and n)
            pieces = total[k]
            assert sum(p["size"] for p in pieces) == sum(want)
            if max(want) <= capacity:
                assert len(pieces) == len(want)
        assert sum(room.values()) / (len(room) * capacity) > 0.9
    assert {r["capacity_id"] for r in got} == {1, 2}
    assert filling(pack(items, "doc_id", "size", limits)).count() == 2


def test_pack_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, size long")
    limits = spark.createDataFrame([(1, 10)], "capacity_id int, capacity_tokens int")
    assert pack(none, "doc_id", "size", limits).count() == 0
    assert pack(spark.createDataFrame([(1, 5)], "doc_id long, size long"), "doc_id", "size", limits.limit(0)).count() == 0


def test_shortage_goes_to_siblings_first():
    tree = plant({("a", "en", "s1"): (0.25, 10.0), ("a", "en", "s2"): (0.25, 1000.0), ("a", "de", "s3"): (0.25, 1000.0), ("b", "en", "s4"): (0.25, 1000.0)})
    assert share_out(tree, 400.0) < 1e-6
    got = leaves_of(tree)
    assert got == pytest.approx({("a", "en", "s1"): 10.0, ("a", "en", "s2"): 190.0, ("a", "de", "s3"): 100.0, ("b", "en", "s4"): 100.0})
    small = plant({("a", "en", "s1"): (0.5, 10.0), ("b", "en", "s2"): (0.5, 100.0)})
    assert share_out(small, 100.0) < 1e-6 and leaves_of(small) == pytest.approx({("a", "en", "s1"): 10.0, ("b", "en", "s2"): 90.0})
    assert share_out(plant({("a",): (1.0, 5.0)}), 8.0) == pytest.approx(3.0)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, domain string, lang string, n_tokens long, hash string")


def test_mixture(spark):
    rng = random.Random(2)
    rows = [(i, "big", "d", rng.choice(["en", None]), rng.randrange(50, 150), f"h{i}") for i in range(900)]
    rows += [(2000 + i, "small", "d", "en", 100, f"s{i // 2}") for i in range(40)]  # twenty texts, each twice
    rows += [(3000, "big", "d", "en", None, "n"), (None, "big", "d", "en", 10, "m"), (3001, None, "d", "en", 10, "k"), (3002, "untold", "d", "en", 10, "j"), (3003, "big", "d", "en", 0, "z")]
    goals = spark.createDataFrame([("big", 0.9, 1), ("small", 0.1, 3), ("absent", 0.2, 2), ("small", 0.05, 9)], "source string, target_share double, max_repeats int")
    chosen, shares = mixture(documents(spark, rows), goals, "doc_id", "source", ("domain", "lang"), "n_tokens", "hash", slices=16)
    got = chosen.collect()
    uses = {}
    for r in got:
        uses[r["doc_id"]] = uses.get(r["doc_id"], 0) + 1
    assert all(n <= (1 if k < 2000 else 3) for k, n in uses.items()) and all(k % 2 == 0 for k in uses if k >= 2000)
    by = {r["source"]: r for r in shares.collect()}
    assert abs(by["big"]["share"] - 0.9) < 0.01 and abs(by["small"]["share"] - 0.1) < 0.01 and by["absent"]["tokens"] == 0
    assert sum(r["tokens"] for r in got) == sum(r["tokens"] for r in by.values())
    again = mixture(documents(spark, rows).repartition(7), goals, "doc_id", "source", ("domain", "lang"), "n_tokens", "hash", slices=16)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    more, report = mixture(documents(spark, rows), goals, "doc_id", "source", ("domain", "lang"), "n_tokens", "hash", total_tokens=90_000)
    by = {r["source"]: r for r in report.collect()}
    assert by["small"]["tokens"] == 6000 and by["small"]["repeats"] == 3 and abs(by["big"]["tokens"] - 84_000) < 200


def test_stretch_grows_with_the_sources(spark):
    """A fixed total is soon too small to leave any source short; a multiple of the greatest full one isn't."""
    rows = [(i, "big", "d", "en", 100, f"h{i}") for i in range(900)] + [(2000 + i, "small", "d", "en", 100, f"s{i}") for i in range(20)]
    goals = spark.createDataFrame([("big", 0.9, 1), ("small", 0.1, 3)], "source string, target_share double, max_repeats int")
    for stretch, small, big in ((0.0, 2000, 18_000), (1.4, 6000, 78_000)):
        shares = mixture(documents(spark, rows), goals, "doc_id", "source", ("domain", "lang"), "n_tokens", "hash", 20_000, stretch=stretch)[1]
        by = {r["source"]: r["tokens"] for r in shares.collect()}
        assert abs(by["small"] - small) <= 100 and abs(by["big"] - big) <= 100


def test_mixture_of_nothing(spark):
    goals = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = mixture(documents(spark, []), goals, "doc_id", "source", ("domain",), "n_tokens", "hash")
    assert chosen.count() == 0 and shares.count() == 1
    chosen, shares = mixture(documents(spark, [(1, "a", "d", "en", 5, "h")]), goals.limit(0), "doc_id", "source", ("domain",), "n_tokens", "hash")
    assert chosen.count() == 0 and shares.count() == 0


def test_word_hashes_and_counts():
    table = np.sort(np.array([Q.word_hash(w) for w in ("the", "über")], np.uint64))
    m = Q.measure(["The cat, ÜBER 12!\nsecond line\n\nthe the", "", "x"], [table])
    assert m["text"].tolist() == [0, 0, 2] and m["common_0"].tolist() == [2, 2, 0]
    assert m["words"].tolist() == [5, 2, 1] and m["digits"].tolist() == [2, 0, 0] and m["lines"].tolist() == [2, 1, 1] and m["ended"].tolist() == [1, 0, 0]


@pytest.mark.parametrize("seed", range(4))
def test_parts_of_a_long_text_change_nothing(seed, monkeypatch):
    """Whole or in parts: the same segments with the same counts, repetition across parts included; lines are never cut."""
    rng = random.Random(seed)
    table = np.sort(np.array([Q.word_hash(w) for w in ("the", "of")], np.uint64))
    block = " ".join(rng.choice(["the", "of", "river", "stone", "x1", "%%"]) for _ in range(40))
    text = "".join(rng.choice(["the river of stone ", "a. ", "12;", "\n", "\n \n", "\r\n", block, "word\n", "long " * 50]) for _ in range(400))
    want = Q.measure([text], [table])
    for size in (1, 300, 2000):
        cut = Q.parts(text, size)
        assert "\n".join(cut).replace("\r", "\n") == text.replace("\r", "\n") and (len(cut) > 3 or size > 300)
        monkeypatch.setattr(Q, "PIECE", size)
        got = Q._measured([text], [table])
        assert want.keys() == got.keys() and all((want[c] == got[c]).all() for c in want), size
    assert Q.parts("no line end " * 500, 10) == ["no line end " * 500]


NOUNS = "man house friend town letter morning river chair garden ticket engine window market sailor".split()


def sentence(rng):
    a, b, c, d = (rng.choice(NOUNS) for _ in range(4))
    return rng.choice([f"The {a} went to the {b} and saw that it was not the {c} he had been told about by his {d}.", f"She said that the {a} would come over in the {b}, but no {c} was there when we looked at the {d}.", f"It has been a long {a} since the last {b} from the {c} by the sea, and we do not know the {d}."])


def test_quality_tells_prose_from_junk(spark):
    rng = random.Random(3)
    common = spark.createDataFrame([("en", w) for w in "the of and to in is was it that he had been by his she they would but no one there when we not from a do".split()] + [(None, "x"), ("en", None)], "lang string, word string")
    prose = {i: rng.choice([" ", "\n", "\n\n"]).join(sentence(rng) for _ in range(6)) for i in range(60)}
    junk = {100: "\n".join(f"| {rng.randrange(999)} | n/a | {rng.random():.3f} |" for _ in range(30)), 101: "\n".join(f"- item x{i}" for i in range(40)), 102: "".join(rng.choice("#$%&@{}[]<>=") for _ in range(500)), 103: "\n".join(["The same line was in the log of the man."] * 60), 104: sentence(rng) + "\n\n" + "\n".join(f"{i};{i * 7}" for i in range(200))}
    other = {200: None, 201: "   \n ", 202: "", 203: sentence(rng) * 30_000}
    rows = [(i, t, "en", 1.0) for i, t in (prose | junk | other).items()] + [(None, sentence(rng), None, 1.0)]
    got = {r["doc_id"]: r for r in Q.text_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, chars double"), "doc_id", "text", "lang", common).collect()}
    assert not {200, 201, 202} & set(got)
    assert all(got[i]["outlying_share"] <= 0.5 for i in prose) and all(got[i]["outlying_share"] > 0.5 for i in junk)
    r = got[100]
    assert max(Q.STATISTICS, key=lambda s: r[f"part_{s}"]) in ("symbol_share", "digit_share", "common_share")


def test_quality_of_nothing(spark):
    common = spark.createDataFrame([("en", "the")], "lang string, word string")
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert Q.text_quality(df, "doc_id", "text", "lang", common).count() == 0
    one = spark.createDataFrame([(1, "hi", None)], "doc_id long, text string, lang string")
    assert Q.text_quality(one, "doc_id", "text", "lang", common.where(F.lit(False))).count() == 1
