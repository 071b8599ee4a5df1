"""Queries on fast replies and author histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators import timing as T
from tallyloom.operators.records import numbered
from tallyloom.plans.base import comments, planted, sql_planted, sql_records, submissions

# The threads of the test tables are slow; dumps are searched with FAST_SECONDS and FAST_LEAST to FAST_EVENTS events, for which a
# thread of fast replies is planted.
FAST_SECONDS, FAST_LEAST, FAST_EVENTS, FAST_THREADS = 10, 3, 5, 3
SIBLING_SECONDS, SIBLING_LEAST = 86400, 1
RESPONSE_SECONDS, RESPONSE_LEAST, RESPONSE_THREADS = 86400, 1, 1
DIRECT_SECONDS, DIRECT_LEAST = 3600, 1
PER_AUTHOR = 100
_COLUMNS = ("author", "subreddit", "created_utc", "link_id", "parent_id")
_FAST_SCHEMA = "id string, author string, subreddit string, created_utc double, link_id string, parent_id string"
# Per thread i: a comment, two quick answers to it by two authors (the later one at the very edge, or half a second within it or beyond), and one by its own author.
_FAST_ROWS = [
    row
    for i in range(7)
    for row in (
        (f"zf{i}a", f"planted_{i % 2}", "planted", 1000.0 * i + 1, f"t3_zt{i}", f"t3_zt{i}"),
        (f"zf{i}b", "planted_quick", "planted", 1000.0 * i + 5, f"t3_zt{i}", f"t1_zf{i}a"),
        (f"zf{i}c", "planted_echo", "planted", 1000.0 * i + 15 + (0.0, 0.5, 1.5)[i % 3], f"t3_zt{i}", f"t1_zf{i}a"),
        (f"zf{i}d", f"planted_{i % 2}", "planted", 1000.0 * i + 40, f"t3_zt{i}", f"t1_zf{i}a"),
    )
]


def _comments(spark: SparkSession, d: str) -> DataFrame:
    return _shaped(comments(spark, d, *_COLUMNS).where("author IS NOT NULL AND created_utc IS NOT NULL"))


def _shaped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("parent", T.bare_id("parent_id")).withColumn("thread", T.bare_id("link_id")).withColumn("parent_type", T.parent_type("parent_id"))


def _with_fast(spark: SparkSession, d: str) -> DataFrame:
    rows = comments(spark, d, *_COLUMNS).unionByName(planted(spark, _FAST_ROWS, _FAST_SCHEMA)).where("author IS NOT NULL AND created_utc IS NOT NULL")
    return _shaped(rows)


def _siblings(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    posts = submissions(spark, d, "subreddit").select(F.col("id").alias("parent"), F.col("subreddit").alias("post_subreddit"))
    near = T.sibling_replies(_comments(spark, d) if rows is None else rows, SIBLING_SECONDS)
    known = near.join(posts.withColumn("is_post", F.lit(True)), "parent", "left")
    return known.withColumn("content_type", F.when(F.col("is_post"), "post").otherwise("comment")).withColumn("subreddit", F.coalesce("post_subreddit", "subreddit"))


def fast_sibling_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _siblings(spark, d).select("author_a", "author_b", F.col("parent").alias("content_id"), "content_type", "delta_seconds", F.col("id_a").alias("comment_a_id"), F.col("id_b").alias("comment_b_id"), "subreddit")


def fast_sibling_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = _siblings(spark, d)
    rows = rows.select(F.least("author_a", "author_b").alias("a"), F.greatest("author_a", "author_b").alias("b"), "content_type", "delta_seconds", "parent", "created_utc_b")
    keys = ["a", "b", "content_type"]
    examples = T.firsts(rows, keys, "parent", "created_utc_b", 5, "example_content_ids")
    return T.pair_rollup(rows, keys, SIBLING_LEAST).join(examples, keys).withColumnsRenamed({"a": "author_a", "b": "author_b"})


def fast_sibling_comment_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Only replies to comments, by the numbers that dumps are searched with: most pairs first."""
    rows = T.sibling_replies(_with_fast(spark, d).where("parent_type = 'comment'"), FAST_SECONDS)
    rows = rows.select(F.least("author_a", "author_b").alias("author_a"), F.greatest("author_a", "author_b").alias("author_b"), "delta_seconds")
    return T.pair_rollup(rows, ["author_a", "author_b"], FAST_LEAST)


def fast_responders_listed(spark: SparkSession, d: str) -> DataFrame:
    """Responders by the numbers that dumps are searched with, in the order of a report: most events, then most threads, then
    least mean delay, then name."""
    found = T.responder_accounts(T.adjacent_responses(_with_fast(spark, d), "thread", FAST_SECONDS), FAST_EVENTS, FAST_THREADS)
    return numbered(found, [F.desc("events"), F.desc("threads"), F.col("avg_delta"), F.col("responder_author")])


def fast_direct_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Accounts that answer directly, by the numbers that dumps are searched with."""
    return T.pair_rollup(T.direct_replies(_with_fast(spark, d), FAST_SECONDS), ["child_author"], FAST_LEAST)


def fast_adjacent_responses(spark: SparkSession, d: str) -> DataFrame:
    return T.adjacent_responses(_comments(spark, d), "thread", RESPONSE_SECONDS)


def fast_responder_accounts(spark: SparkSession, d: str) -> DataFrame:
    return T.responder_accounts(fast_adjacent_responses(spark, d), RESPONSE_LEAST, RESPONSE_THREADS)


def _direct(spark: SparkSession, d: str) -> DataFrame:
    # prefixes are optional in dumps of comments, so the lookup is by the bare id
    return T.direct_replies(_comments(spark, d), DIRECT_SECONDS)


def direct_parent_replies(spark: SparkSession, d: str) -> DataFrame:
    return _direct(spark, d)


def direct_reply_accounts(spark: SparkSession, d: str) -> DataFrame:
    return T.pair_rollup(_direct(spark, d), ["child_author"], DIRECT_LEAST)


def reply_deltas(spark: SparkSession, d: str) -> DataFrame:
    """The latest comments of each author, beside the time since the parent, be it a comment or a post."""
    rows = _comments(spark, d)
    recent = rows.withColumn("k", F.row_number().over(W.partitionBy("author").orderBy(F.desc("created_utc"), F.desc("id")))).where(F.col("k") <= PER_AUTHOR)
    posts = submissions(spark, d, "author", "created_utc").select(F.lit("post").alias("parent_type"), F.col("id").alias("parent"), F.col("author").alias("parent_author"), F.col("created_utc").alias("parent_utc"))
    parents = rows.select(F.lit("comment").alias("parent_type"), F.col("id").alias("parent"), F.col("author").alias("parent_author"), F.col("created_utc").alias("parent_utc")).union(posts)
    both = recent.join(parents, ["parent_type", "parent"], "left")
    return both.select("author", "id", "k", "parent_type", "parent_author", T.whole_seconds(F.col("created_utc"), F.col("parent_utc")).alias("delta_seconds"))


def recent_n_per_author(spark: SparkSession, d: str) -> DataFrame:
    rows = comments(spark, d, "author", "created_utc").where("author IS NOT NULL AND created_utc IS NOT NULL")
    return rows.withColumn("k", F.row_number().over(W.partitionBy("author").orderBy(F.desc("created_utc"), F.desc("id")))).where(F.col("k") <= PER_AUTHOR).select("author", "id", "k")


def post_comment_counts(spark: SparkSession, d: str) -> DataFrame:
    """Comments of known posts, and how many follow the one before within a day by another author."""
    posts = submissions(spark, d, "title").select(F.col("id").alias("thread"))
    rows = _comments(spark, d).join(posts, "thread", "left_semi")
    fast = T.adjacent_responses(rows, "thread", RESPONSE_SECONDS).groupBy(F.col("thread_id").alias("thread")).agg(F.count(F.lit(1)).alias("fast"))
    return rows.groupBy("thread").agg(F.count(F.lit(1)).alias("n_comments"), F.countDistinct("author").alias("n_authors")).join(fast, "thread", "left").select("thread", "n_comments", "n_authors", F.coalesce("fast", F.lit(0)).alias("fast_responses"))


_C = sql_records("comments", "c0", *_COLUMNS) + """,
c AS (SELECT *, regexp_replace(parent_id, '^t[123]_', '') AS parent, regexp_replace(link_id, '^t[123]_', '') AS thread,
  CASE WHEN parent_id LIKE 't1\\_%' ESCAPE '\\' THEN 'comment' WHEN parent_id IS NOT NULL THEN 'post' END AS parent_type
  FROM c0 WHERE author IS NOT NULL AND created_utc IS NOT NULL)"""
_P = sql_records("submissions", "p", "subreddit", "author", "created_utc")


_ON_COMMENTS = "AND a.parent_type = 'comment' AND b.parent_type = 'comment'"


def _pairs(where: str, seconds: int = SIBLING_SECONDS) -> str:
    return f"""near AS (SELECT a.parent, a.author AS author_a, b.author AS author_b, a.id AS id_a, b.id AS id_b, b.created_utc AS tb, a.subreddit,
  CAST(trunc(b.created_utc - a.created_utc) AS INT) AS delta_seconds
  FROM c a JOIN c b ON a.parent = b.parent AND a.author <> b.author AND (a.created_utc, a.id) < (b.created_utc, b.id) AND trunc(b.created_utc - a.created_utc) <= {seconds} {where})"""


_NEAR = _pairs("") + ", known AS (SELECT near.*, CASE WHEN p.id IS NOT NULL THEN 'post' ELSE 'comment' END AS content_type, coalesce(p.subreddit, near.subreddit) AS sub FROM near LEFT JOIN p ON p.id = near.parent)"


def _rollup(source: str, keys: str, least: int) -> str:
    return f"""g AS (SELECT {keys}, count(*) AS instances, max(delta_seconds) AS max_delta, round(avg(delta_seconds), 2) AS avg_delta, min(delta_seconds) AS min_delta FROM {source} GROUP BY {keys}),
r AS (SELECT *, round(instances / (SELECT max(instances) FROM g), 3) AS normalized_frequency FROM g WHERE instances >= {least})"""


_ADJACENT = f"""l AS (SELECT *, lag(author) OVER w AS pa, lag(created_utc) OVER w AS pt, lag(id) OVER w AS pi FROM c WHERE thread IS NOT NULL WINDOW w AS (PARTITION BY thread ORDER BY created_utc, id)),
e AS (SELECT thread AS thread_id, subreddit, author AS responder_author, pa AS previous_author, id AS responder_comment_id, pi AS previous_comment_id, CAST(trunc(created_utc - pt) AS INT) AS delta_seconds
  FROM l WHERE pa <> author)"""
_DIRECT = f"""r0 AS (SELECT a.author AS child_author, b.author AS parent_author, b.id AS parent_comment_id, a.id AS child_comment_id, a.thread AS root_post_id, a.subreddit, CAST(trunc(a.created_utc - b.created_utc) AS INT) AS delta_seconds
  FROM c a JOIN c b ON a.parent = b.id WHERE a.author <> b.author AND trunc(a.created_utc - b.created_utc) BETWEEN 0 AND {DIRECT_SECONDS})"""

_FAST = f"""WITH {sql_records('comments', 'c1', *_COLUMNS)}, c0 AS (SELECT id, author, subreddit, created_utc, link_id, parent_id FROM c1 UNION ALL SELECT id, author, subreddit, created_utc, link_id, parent_id FROM {sql_planted(_FAST_ROWS, _FAST_SCHEMA)}){_C[_C.index(","  + chr(10) + "c AS"):]}"""

QUERIES = {f.__name__: f for f in (fast_sibling_pairs, fast_sibling_rollup, fast_sibling_comment_rollup, fast_responders_listed, fast_direct_accounts, fast_adjacent_responses, fast_responder_accounts, direct_parent_replies, direct_reply_accounts, reply_deltas, recent_n_per_author, post_comment_counts)}
SQL = {
    "fast_sibling_pairs": f"WITH {_C}, {_P}, {_NEAR} SELECT author_a, author_b, parent AS content_id, content_type, delta_seconds, id_a AS comment_a_id, id_b AS comment_b_id, sub AS subreddit FROM known",
    "fast_sibling_rollup": f"""WITH {_C}, {_P}, {_NEAR}, k AS (SELECT least(author_a, author_b) AS a, greatest(author_a, author_b) AS b, content_type, delta_seconds, parent, tb FROM known),
{_rollup('k', 'a, b, content_type', SIBLING_LEAST)},
x AS (SELECT a, b, content_type, parent, min(tb) AS o FROM k GROUP BY ALL),
y AS (SELECT *, row_number() OVER (PARTITION BY a, b, content_type ORDER BY o, parent) AS n FROM x),
z AS (SELECT a, b, content_type, string_agg(parent, ', ' ORDER BY n) AS example_content_ids FROM y WHERE n <= 5 GROUP BY ALL)
SELECT r.a AS author_a, r.b AS author_b, r.content_type, instances, max_delta, avg_delta, min_delta, normalized_frequency, example_content_ids FROM r JOIN z USING (a, b, content_type)""",
    "fast_sibling_comment_rollup": f"{_FAST}, {_pairs(_ON_COMMENTS, FAST_SECONDS)}, k AS (SELECT least(author_a, author_b) AS author_a, greatest(author_a, author_b) AS author_b, delta_seconds FROM near), {_rollup('k', 'author_a, author_b', FAST_LEAST)} SELECT * FROM r",
    "fast_responders_listed": f"""{_FAST}, {_ADJACENT}, r AS (SELECT responder_author, count(*) AS events, count(DISTINCT thread_id) AS threads, count(DISTINCT previous_author) AS partners, round(avg(delta_seconds), 2) AS avg_delta, min(delta_seconds) AS min_delta
FROM e WHERE delta_seconds BETWEEN 0 AND {FAST_SECONDS} GROUP BY 1 HAVING count(*) >= {FAST_EVENTS} AND count(DISTINCT thread_id) >= {FAST_THREADS})
SELECT *, row_number() OVER (ORDER BY events DESC, threads DESC, avg_delta, responder_author) AS place FROM r""",
    "fast_direct_accounts": f"{_FAST}, {_DIRECT.replace(str(DIRECT_SECONDS), str(FAST_SECONDS))}, {_rollup('r0', 'child_author', FAST_LEAST)} SELECT * FROM r",
    "fast_adjacent_responses": f"WITH {_C}, {_ADJACENT} SELECT * FROM e WHERE delta_seconds BETWEEN 0 AND {RESPONSE_SECONDS}",
    "fast_responder_accounts": f"""WITH {_C}, {_ADJACENT} SELECT responder_author, count(*) AS events, count(DISTINCT thread_id) AS threads, count(DISTINCT previous_author) AS partners, round(avg(delta_seconds), 2) AS avg_delta, min(delta_seconds) AS min_delta
FROM e WHERE delta_seconds BETWEEN 0 AND {RESPONSE_SECONDS} GROUP BY 1 HAVING count(*) >= {RESPONSE_LEAST} AND count(DISTINCT thread_id) >= {RESPONSE_THREADS}""",
    "direct_parent_replies": f"WITH {_C}, {_DIRECT} SELECT * FROM r0",
    "direct_reply_accounts": f"WITH {_C}, {_DIRECT}, {_rollup('r0', 'child_author', DIRECT_LEAST)} SELECT * FROM r",
    "reply_deltas": f"""WITH {_C}, {_P}, t AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY created_utc DESC, id DESC) AS k FROM c),
q AS (SELECT 'comment' AS parent_type, id AS parent, author AS parent_author, created_utc AS pu FROM c UNION ALL SELECT 'post', id, author, created_utc FROM p)
SELECT t.author, t.id, t.k, t.parent_type, q.parent_author, CAST(trunc(t.created_utc - q.pu) AS INT) AS delta_seconds FROM t LEFT JOIN q USING (parent_type, parent) WHERE k <= {PER_AUTHOR}""",
    "recent_n_per_author": f"WITH {_C} SELECT author, id, row_number() OVER (PARTITION BY author ORDER BY created_utc DESC, id DESC) AS k FROM c QUALIFY k <= {PER_AUTHOR}",
    "post_comment_counts": f"""WITH {_C}, {_P}, {_ADJACENT}, f AS (SELECT thread_id, count(*) AS n FROM e WHERE delta_seconds BETWEEN 0 AND {RESPONSE_SECONDS} GROUP BY 1)
SELECT thread, count(*) AS n_comments, count(DISTINCT author) AS n_authors, coalesce(any_value(f.n), 0) AS fast_responses FROM c LEFT JOIN f ON f.thread_id = c.thread WHERE thread IN (SELECT id FROM p) GROUP BY thread""",
}
