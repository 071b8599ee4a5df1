"""Queries on authors that share threads, communities or links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import urls as U
from tallyloom.operators import cooccurrence as C
from tallyloom.operators.blocks import Blocks
from tallyloom.operators.timing import bare_id
from tallyloom.plans.base import comments, planted, sql_planted, sql_records, submissions
from tallyloom.session import cut

ROUNDS = 20
SAMPLED_PAIRS = 1000
CHARACTER_COSINE = 0.9
LINK_COSINE, LINK_SHARED = 0.6, 2
# The generated tables hold no two authors with the same links, so some are planted.
_LINK_SCHEMA = "id string, author string, url string, url_overridden_by_dest string, title string, selftext string"
_LINK_ROWS = [
    ("zz1", "planted_one", "https://www.A.example/x/?utm=1", None, "news", "see https://b.example/y#top and (https://c.example/z)"),
    ("zz2", "planted_two", "http://other.example/", "https://a.example/x", None, "https://B.example/y https://c.example/z/"),
    ("zz3", "planted_two", "/r/somewhere/comments/1/", None, None, None),
    ("zz4", "planted_three", "/r/somewhere/comments/1", None, None, "https://a.example/x https://i.imgur.com/1.png"),
    ("zz5", "planted_three", "b.example/y", None, "https://b.example/y", ""),
    ("zz7", "planted_three", "https://a.example/x", "https://b.example/y", None, None),
    ("zz8", "planted_one", "https://a.example/x", "https://b.example/y", None, None),
    ("zz6", "planted_four", "https://i.imgur.com/1.png", None, None, "https://d.example/only"),
]


def _thread_tokens(spark: SparkSession, d: str) -> DataFrame:
    return comments(spark, d, "author", "link_id").where("author IS NOT NULL AND link_id IS NOT NULL").select("author", bare_id("link_id").alias("token"))


def _community_tokens(spark: SparkSession, d: str) -> DataFrame:
    return comments(spark, d, "author", "subreddit").where("author IS NOT NULL AND subreddit IS NOT NULL").select("author", F.col("subreddit").alias("token"))


def _link_tokens(spark: SparkSession, d: str, mode: str = "domain") -> DataFrame:
    rows = submissions(spark, d, "author", "url", "url_overridden_by_dest", "title", "selftext", "is_self", "domain").where("author IS NOT NULL AND NOT coalesce(is_self, true)")
    rows = rows.where(F.col("domain").isNull() | ~F.col("domain").isin(*U.EXCLUDED_DOMAINS))
    text = F.concat_ws(" ", "title", "selftext")
    tokens = U.post_tokens(mode, F.col("url"), F.col("url_overridden_by_dest"), F.col("domain"), text)
    return rows.select("author", F.explode(tokens).alias("token")).where(~F.col("token").isin(*U.EXCLUDED_DOMAINS))


def _shown(df: DataFrame, tokens: DataFrame) -> DataFrame:
    there = [c for c in ("percentile_rank", "shared_tokens") if c in df.columns]
    forms = {"percentile_rank": F.round("percentile_rank", 2).alias("percentile_rank"), "shared_tokens": F.col("shared_tokens")}
    shown = df.select("user_1", "user_2", F.round("similarity", 5).alias("cosine_similarity"), F.col("shared").alias("shared_count"), F.round("threshold", 5).alias("threshold"), *[forms[c] for c in there])
    return shown if "shared_tokens" in there else C.shared_tokens(cut(shown), tokens, "user_1", "user_2")


def co_submission_pairs(spark: SparkSession, d: str) -> DataFrame:
    tokens = _thread_tokens(spark, d)
    return _shown(C.alike(tokens, 5), tokens)


def co_subreddit_pairs(spark: SparkSession, d: str) -> DataFrame:
    tokens = _community_tokens(spark, d)
    return _shown(C.alike(tokens, 5, least_features=0, full_matrix=True), tokens)


def co_url_pairs(spark: SparkSession, d: str) -> DataFrame:
    tokens = _link_tokens(spark, d)
    return _shown(C.alike(tokens, 2, strict=True, full_matrix=True), tokens)


def co_url_full_pairs(spark: SparkSession, d: str) -> DataFrame:
    """As co_url_pairs, with whole URLs as tokens, planted rows among them."""
    tokens = _link_tokens(spark, d, "full_url").union(planted(spark, _LINK_ROWS, _LINK_SCHEMA).select("author", F.explode(F.array("url", "url_overridden_by_dest")).alias("token")).where("token IS NOT NULL"))
    tokens = tokens.union(tokens.where("author LIKE 'planted%'"))
    return _shown(C.alike(tokens, 2, strict=True, least_features=1, full_matrix=True, percent=50.0), tokens)


def co_url_sampled_pairs(spark: SparkSession, d: str) -> DataFrame:
    """As co_url_pairs, above the percentile of a sample of pairs, without making the others."""
    tokens = cut(_link_tokens(spark, d))
    return _shown(C.alike(tokens, 2, strict=True, sample=SAMPLED_PAIRS), tokens)


def link_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Full URLs in normal form from links and texts; at least LINK_SHARED shared and a cosine of LINK_COSINE."""
    rows = submissions(spark, d, "author", "url", "url_overridden_by_dest", "title", "selftext").where("author IS NOT NULL")
    rows = rows.unionByName(planted(spark, _LINK_ROWS, _LINK_SCHEMA))
    urls = rows.select("author", F.explode(U.record_urls(rows.schema)).alias("u")).select("author", U.normal_url("u").alias("token")).distinct()
    tokens = cut(urls.where(~U.domain_by_prefix("token").isin(*U.EXCLUDED_DOMAINS)))
    pairs = C.shared_cosine(cut(C.tfidf(tokens)), LINK_COSINE).where(F.col("shared") >= LINK_SHARED)
    shown = pairs.select(F.col("a").alias("author_a"), F.col("b").alias("author_b"), F.round("similarity", 5).alias("cosine_sim"), F.col("shared").alias("shared_count"))
    return C.shared_tokens(cut(shown), tokens, "author_a", "author_b", None, ";")


def link_domains_of_texts(spark: SparkSession, d: str) -> DataFrame:
    """(domain, n_authors, n): hosts of the URLs in titles and selftexts only, in normal form."""
    rows = submissions(spark, d, "author", "title", "selftext").where("author IS NOT NULL")
    urls = rows.select("author", F.explode(U.record_urls(rows.schema)).alias("u")).select("author", U.url_token(U.normal_url("u"), "domain").alias("domain"))
    return urls.where("domain <> ''").groupBy("domain").agg(F.countDistinct("author").alias("n_authors"), F.count(F.lit(1)).alias("n"))


def co_url_null_model(spark: SparkSession, d: str) -> DataFrame:
    """The similarity that random exchanges of link domains reach by chance, by whole domains and by characters and pairs of
    characters, one row each. Dumps are searched with 1,000 repeats; a percentile of so many pairs is steady with ROUNDS."""
    tokens = cut(C.active(_link_tokens(spark, d), 2, strict=True))
    found = [(kind, ROUNDS, float(C.null_percentile(tokens, ROUNDS, 99.0, grams=kind == "characters"))) for kind in ("domains", "characters")]
    return spark.createDataFrame(found, "tokens string, repeats int, threshold double")


def co_url_character_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of authors with a cosine of 0.9 or more over the characters and pairs of characters of their link domains."""
    grams = C.char_grams(C.active(_link_tokens(spark, d), 2, strict=True))
    pairs = Blocks(C.tfidf(grams)).pairs(CHARACTER_COSINE)  # most authors have most grams, so what they share picks few pairs out
    return pairs.select(F.col("a").alias("user_1"), F.col("b").alias("user_2"), F.round("similarity", 5).alias("cosine_similarity"), F.col("shared").alias("shared_grams"))


def _tfidf_sql(tokens: str, keep: str, least_features: int, percent: float, full: bool) -> str:
    diagonal, each, total = ("(SELECT n FROM m)", 2, "(SELECT n * n FROM m)") if full else ("0", 1, "(SELECT n * (n - 1) / 2 FROM m)")
    return f"""{tokens},
act AS (SELECT author FROM tok GROUP BY author HAVING {keep}),
tf AS (SELECT author, token, count(*) AS tf FROM tok WHERE author IN (SELECT author FROM act) GROUP BY 1, 2),
nn AS (SELECT count(DISTINCT author) AS n FROM tf),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) BETWEEN 2 AND 0.9 * (SELECT n FROM nn)),
raw AS (SELECT author, token, tf * (ln((1.0 + (SELECT n FROM nn)) / (1 + df)) + 1) AS x FROM tf JOIN df USING (token)),
nrm AS (SELECT author, sqrt(sum(x * x)) AS l FROM raw GROUP BY 1 HAVING count(*) >= {least_features}),
w AS (SELECT author, token, x / l AS w FROM raw JOIN nrm USING (author)),
m AS (SELECT count(*) AS n FROM nrm),
pr AS (SELECT a.author AS user_1, b.author AS user_2, round(sum(a.w * b.w), 9) AS s, count(*) AS shared FROM w a JOIN w b ON a.token = b.token AND a.author < b.author GROUP BY 1, 2),
z AS (SELECT (SELECT n * (n - 1) / 2 FROM m) AS total, count(*) AS known FROM pr WHERE s > 0),
pos AS (SELECT total - known AS zeros, {percent / 100} * (total - 1) AS spot FROM z),
srt AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS k FROM pr WHERE s > 0),
th AS (SELECT lo + (hi - lo) * (spot - floor(spot)) AS t FROM (SELECT spot, coalesce((SELECT s FROM srt WHERE k = floor(spot) - zeros), 0) AS lo, coalesce((SELECT s FROM srt WHERE k = floor(spot) + 1 - zeros), 0) AS hi FROM pos)),
lv AS (SELECT s, count(*) * {each} AS c FROM pr GROUP BY 1),
lu AS (SELECT s, c, sum(c) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) + {total} - {each} * (SELECT count(*) FROM pr) - {diagonal} + CASE WHEN s >= 1 THEN {diagonal} ELSE 0 END AS upto FROM lv)
SELECT user_1, user_2, round(pr.s, 5) AS cosine_similarity, shared AS shared_count, round(50.0 * (upto - c + upto + 1) / {total}, 2) AS percentile_rank, round(t, 5) AS threshold,
  (SELECT array_to_string(list_sort(list(token))[:10], '; ') FROM (SELECT DISTINCT token FROM tok WHERE author = user_1 INTERSECT SELECT DISTINCT token FROM tok WHERE author = user_2)) AS shared_tokens FROM pr JOIN lu USING (s), th WHERE pr.s > t"""


_EX = ", ".join(f"'{x}'" for x in U.EXCLUDED_DOMAINS)
_DIRECT = U.URL_DIRECT.replace("\\'", "'").replace("'", "''")
_LINKS = U.URL_LINKS.replace("'", "''")
_THREADS = "WITH " + sql_records("comments", "c0", "author", "link_id") + ", tok AS (SELECT author, regexp_replace(link_id, '^t[123]_', '') AS token FROM c0 WHERE author IS NOT NULL AND link_id IS NOT NULL)"
_COMMUNITIES = "WITH " + sql_records("comments", "c0", "author", "subreddit") + ", tok AS (SELECT author, subreddit AS token FROM c0 WHERE author IS NOT NULL AND subreddit IS NOT NULL)"
_HOST = "regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)), '^www\\.', '')"
_DOMAINS = "WITH " + sql_records("submissions", "s0", "author", "url", "url_overridden_by_dest", "title", "selftext", "is_self", "domain") + f""",
s AS (SELECT * FROM s0 WHERE author IS NOT NULL AND NOT coalesce(is_self, true) AND (domain IS NULL OR domain NOT IN ({_EX}))),
i AS (SELECT author, domain, unnest(regexp_extract_all(concat_ws(' ', title, selftext), '{_DIRECT}')) AS u FROM s),
tok AS (SELECT * FROM (SELECT author, domain AS token FROM s WHERE domain IS NOT NULL UNION ALL SELECT author, {_HOST} FROM i WHERE {_HOST} <> '' AND coalesce({_HOST} <> domain, true)) WHERE token NOT IN ({_EX}))"""
_LINK_PLANTED = sql_planted(_LINK_ROWS, _LINK_SCHEMA)
_PART = lambda i: f"regexp_extract(u, '^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)?(//[^/?#]*)?([^?#]*)', {i})"
_SCHEME, _AT, _PATH = f"coalesce(nullif(lower({_PART(1)}), ''), 'http')", f"regexp_replace(lower(substr({_PART(2)}, 3)), '^www\\.', '')", f"rtrim(regexp_replace({_PART(3)}, ';[^/]*$', ''), '/')"
_NORMAL = f"{_SCHEME} || ':' || CASE WHEN {_AT} <> '' OR ({_SCHEME} IN ('http', 'https', 'ftp') AND ({_PATH} = '' OR starts_with({_PATH}, '/'))) THEN '//' ELSE '' END || {_AT} || {_PATH}"
_URLS = "WITH " + sql_records("submissions", "s0", "author", "url", "url_overridden_by_dest", "title", "selftext", "is_self", "domain") + f""",
s AS (SELECT *, coalesce(nullif(url_overridden_by_dest, ''), url) AS main FROM s0 WHERE author IS NOT NULL AND NOT coalesce(is_self, true) AND (domain IS NULL OR domain NOT IN ({_EX}))),
i AS (SELECT author, main, unnest(regexp_extract_all(concat_ws(' ', title, selftext), '{_DIRECT}')) AS u FROM s),
tok0 AS (SELECT * FROM (SELECT author, main AS token FROM s WHERE main <> '' UNION ALL SELECT author, u FROM i WHERE u <> '' AND coalesce(u <> main, true)) WHERE token NOT IN ({_EX})
  UNION ALL SELECT * FROM (SELECT author, unnest([url, url_overridden_by_dest]) AS token FROM {_LINK_PLANTED}) WHERE token IS NOT NULL),
tok AS (SELECT * FROM tok0 UNION ALL SELECT * FROM tok0 WHERE author LIKE 'planted%')"""

QUERIES = {f.__name__: f for f in (co_submission_pairs, co_subreddit_pairs, co_url_pairs, co_url_full_pairs, co_url_sampled_pairs, link_similarity_pairs, link_domains_of_texts, co_url_null_model, co_url_character_pairs)}
SQL = {
    "co_submission_pairs": _tfidf_sql(_THREADS, "count(*) >= 5", 2, 99.0, False),
    "co_subreddit_pairs": _tfidf_sql(_COMMUNITIES, "count(*) >= 5", 0, 99.0, True),
    "co_url_pairs": _tfidf_sql(_DOMAINS, "count(*) > 2", 2, 99.0, True),
    "co_url_full_pairs": _tfidf_sql(_URLS, "count(*) > 2", 1, 50.0, True),
    "link_similarity_pairs": "WITH " + sql_records("submissions", "s0", "author", "url", "url_overridden_by_dest", "title", "selftext") + f""",
s1 AS (SELECT author, url, url_overridden_by_dest, title, selftext FROM s0 WHERE author IS NOT NULL UNION ALL SELECT author, url, url_overridden_by_dest, title, selftext FROM {_LINK_PLANTED}),
x AS (SELECT author, unnest(list_filter([url, url_overridden_by_dest] || coalesce(regexp_extract_all(title, '{_LINKS}'), []) || coalesce(regexp_extract_all(selftext, '{_LINKS}'), []), lambda v: v IS NOT NULL AND v <> '')) AS u FROM s1),
tok AS (SELECT DISTINCT author, token FROM (SELECT author, {_NORMAL} AS token FROM x) WHERE {_HOST.replace('(u,', '(token,')} NOT IN ({_EX})),
nn AS (SELECT count(DISTINCT author) AS n FROM tok), df AS (SELECT token, count(*) AS df FROM tok GROUP BY 1),
raw AS (SELECT author, token, ln((1.0 + (SELECT n FROM nn)) / (1 + df)) + 1 AS x FROM tok JOIN df USING (token)),
nrm AS (SELECT author, sqrt(sum(x * x)) AS l FROM raw GROUP BY 1), w AS (SELECT author, token, x / l AS w FROM raw JOIN nrm USING (author))
SELECT a.author AS author_a, b.author AS author_b, round(sum(a.w * b.w), 5) AS cosine_sim, count(*) AS shared_count, string_agg(a.token, ';' ORDER BY a.token) AS shared_tokens FROM w a JOIN w b ON a.token = b.token AND a.author < b.author GROUP BY 1, 2 HAVING sum(a.w * b.w) >= {LINK_COSINE} AND count(*) >= {LINK_SHARED}""",
    "link_domains_of_texts": "WITH " + sql_records("submissions", "s0", "author", "title", "selftext") + f""",
x AS (SELECT author, unnest(coalesce(regexp_extract_all(title, '{_LINKS}'), []) || coalesce(regexp_extract_all(selftext, '{_LINKS}'), [])) AS u FROM s0 WHERE author IS NOT NULL)
SELECT {_HOST} AS domain, count(DISTINCT author) AS n_authors, count(*) AS n FROM x WHERE {_HOST} <> '' GROUP BY 1""",
    "co_url_character_pairs": f"""{_DOMAINS}, act AS (SELECT author FROM tok GROUP BY author HAVING count(*) > 2),
j AS (SELECT author, string_agg(lower(token), ' ' ORDER BY lower(token)) AS t FROM tok WHERE author IN (SELECT author FROM act) GROUP BY 1),
g AS (SELECT author, unnest([substr(t, i, 1) for i in range(1, length(t) + 1)] || [substr(t, i, 2) for i in range(1, length(t))]) AS token FROM j),
tf AS (SELECT author, token, count(*) AS tf FROM g GROUP BY 1, 2), nn AS (SELECT count(DISTINCT author) AS n FROM tf), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
raw AS (SELECT author, token, tf * (ln((1.0 + (SELECT n FROM nn)) / (1 + df)) + 1) AS x FROM tf JOIN df USING (token)),
nrm AS (SELECT author, sqrt(sum(x * x)) AS l FROM raw GROUP BY 1), w AS (SELECT author, token, x / l AS w FROM raw JOIN nrm USING (author))
SELECT a.author AS user_1, b.author AS user_2, round(sum(a.w * b.w), 5) AS cosine_similarity, count(*) AS shared_grams FROM w a JOIN w b ON a.token = b.token AND a.author < b.author GROUP BY 1, 2 HAVING sum(a.w * b.w) >= {CHARACTER_COSINE}""",
}
