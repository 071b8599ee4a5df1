"""URL, rule and style functions on rows made for one rule each."""

import math

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import rules as R
from tallyloom.functions import stylometrics as Y
from tallyloom.functions import text as X
from tallyloom.functions import urls as U


def apply(spark, column, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column.alias("y")).collect()]


def test_names(spark):
    assert apply(spark, X.author("x"), [" a ", "\tb ", "", None, "[deleted]", " AutoModerator ", "[removed]", "c d"]) == ["a", "b", None, None, None, None, None, "c d"]
    assert apply(spark, X.community("x"), ["r/A_b", "/r/C ", " R/d ", "r/", "", None, "radio"]) == ["a_b", "c", "d", None, None, None, "radio"]
    assert apply(spark, X.domain("x"), ["WWW.a.test ", "www.www.b.test", "self.x", "", None, "w.c.test"]) == ["a.test", "www.b.test", None, None, None, "w.c.test"]
    assert apply(spark, X.word_count("x"), ["", "  ", "a b\n c", None]) == [0, 0, 3, None]
    assert apply(spark, X.preview("x", 8), ["short", "a  rather long text"]) == ["short", "a rat..."]


def test_three_url_patterns_differ(spark):
    text = "see (https://a.test/x]y) \"http://b.test/q'r\" HTTP://C.test/z> end"
    assert apply(spark, U.extract_urls("x"), [text, None]) == [["https://a.test/x", "http://b.test/q"], []]
    assert apply(spark, U.extract_urls("x", U.URL_DIRECT), [text])[0] == ["https://a.test/x]y", "http://b.test/q"]
    assert apply(spark, U.extract_urls("x", U.URL_LINKS), [text])[0] == ["https://a.test/x", "http://b.test/q", "HTTP://C.test/z"]


def test_domains_and_normal_form(spark):
    urls = ["https://www.wikipedia.org/a", "http://WWW.Example.test:80/x?y#z", "nothing", "https://user@w.test"]
    assert apply(spark, U.domain_by_set("x"), urls) == ["ikipedia.org", "example.test:80", "", "user@w.test"]
    assert apply(spark, U.domain_by_prefix("x"), urls) == ["wikipedia.org", "example.test:80", "", "user@w.test"]
    assert apply(spark, U.normal_url("x"), ["HTTPS://www.A.test/P/q/?a=1#f", "http://b.test", "http://c.test/p;v=1?x", "/r/a/comments/1/", "foo.example/x", "//www.h.test/y", "mailto:x@y", None]) == ["https://a.test/P/q", "http://b.test", "http://c.test/p", "http:///r/a/comments/1", "http:foo.example/x", "http://h.test/y", "mailto:x@y", None]


def test_urls_of_records_and_tokens(spark):
    df = spark.createDataFrame([("https://a.test/1", None, "t https://b.test/2", "")], "url string, url_overridden_by_dest string, title string, selftext string")
    assert df.select(U.record_urls(df.schema)).first()[0] == ["https://a.test/1", "https://b.test/2"]
    nested = spark.range(1).select(F.expr("struct(array(struct(struct('https://p.test' AS url) AS source)) AS images) AS preview"), F.expr("struct(struct(cast(null AS string) AS url, 'https://t.test' AS thumbnail_url) AS oembed) AS media"), F.expr("map('k', struct(struct('https://m.test' AS u, '' AS url) AS s)) AS media_metadata"))
    assert nested.select(U.record_urls(nested.schema)).first()[0] == ["https://p.test", "https://t.test", "https://m.test"]
    tokens = U.post_tokens("domain", F.lit("u"), F.lit(None), F.lit("WWW.a.test"), F.col("x"))
    assert apply(spark, tokens, ["https://www.a.test/q https://b.test/r", None]) == [["a.test", "b.test"], ["a.test"]]


def test_name_rules(spark):
    names = ["bot", "news-bot", "newsbot", "link_bot", "bottom", "iron_mod", "AutoTLDR", "x auto y", "mod", "bot_a", "", None]
    assert apply(spark, R.name_pattern("x", R.NOT_BOTS), names) == ["exact", "bot", None, "_bot", None, None, None, None, "mod", "_bot", None, None]
    labels = apply(spark, R.name_label("x", R.NOT_BOTS)["label"], names[:-2])
    assert labels == ["bot", "bot", "human", "bot", "human", "human", "bot", "bot", "bot", "bot"]


def test_phrases(spark):
    texts = ["I'm a bot, hi", "i'm a bottom", "BEEP BOOP!", "this action was performed automatically", None, ""]
    assert apply(spark, R.has_phrase("x"), texts) == [True, False, True, True, False, False]
    assert apply(spark, R.has_phrase("x", R.DIAGNOSIS_PHRASES), texts) == [True, False, True, False, False, False]


def test_keywords(spark):
    k = R.keyword_class(R.keyword_words("x"))
    got = apply(spark, k, ["Stock, (market)! stock", "money at the fleamarket", "nothing"])
    assert [(r["is_match"], r["keyword_count"]) for r in got] == [(True, 2), (False, 1), (False, 0)]


def test_style(spark):
    assert apply(spark, Y.longest_run("x", "^"), ["a^^^b^", "", None, "none"]) == [3, 0, 0, 0]
    assert apply(spark, Y.count_of("x", "*"), ["**a*", ""]) == [3, 0]
    assert apply(spark, Y.upper_count("x"), ["ÀBc1"]) == [2]
    assert apply(spark, Y.ascii_words("x"), ["Don't 2day café über plain_x"]) == [["don", "t"]]
    assert apply(spark, Y.space_entropy("x"), ["a b\nc", "ab", "a  b"]) == [1.0, 0.0, 0.0]
    r = apply(spark, Y.name_shape("x"), ["ab_1"])[0]
    assert (r["length"], r["digit_ratio"], r["entropy"], r["ends_with_digit"], r["has_underscore"]) == (4, 0.25, 2.0, 1, 1)


@pytest.mark.parametrize("values,expected", [([1, 2, 4, 7, 11], 2.834653450), ([i * i for i in range(1, 12)], 4.788232632), ([1, 2, 3, 4], None), ([], None), ([3] * 12, -math.inf)])
def test_differential_entropy(spark, values, expected):
    got = apply(spark, Y.differential_entropy(F.col("x")), [[float(v) for v in values]], "array<double>")[0]
    assert got == expected if expected is None or math.isinf(expected) else math.isclose(got, expected, rel_tol=1e-9)


def test_entropy_of_large_samples(spark):
    got = apply(spark, Y.differential_entropy(F.col("x")), [[i / 2000 for i in range(2000)]], "array<double>")[0]
    assert abs(got) < 0.1


def test_urls_of_cross_posts_and_galleries(spark):
    from tallyloom.schema import linked
    from tallyloom.sources.files import parse_lines

    gallery = '{"a": {"s": {"u": "https://g.test/1"}}, "b": {"p": {"u": "https://g.test/2"}}, "c": {"p": [{"u": "https://g.test/3"}]}}'
    third = '{"url": "https://c.test/3", "selftext": null}'
    second = '{"title": "see https://c.test/2", "crosspost_parent_list": [%s]}' % third
    line = '{"id": "1", "url": "https://c.test/0", "media_metadata": %s, "crosspost_parent_list": [{"media": {"oembed": {"url": "", "thumbnail_url": "https://c.test/1"}}, "crosspost_parent_list": [%s]}]}' % (gallery, second)
    rows = parse_lines(spark.createDataFrame([(line,), ('{"id": "2"}',)], "value string"), linked())
    got = {r["id"]: r["u"] for r in rows.select("id", U.record_urls(linked()).alias("u")).collect()}
    assert got == {"1": ["https://c.test/0", "https://g.test/1", "https://g.test/2", "https://c.test/1", "https://c.test/2", "https://c.test/3"], "2": []}
