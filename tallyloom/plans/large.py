"""Queries p1, p4 and p6: the general operators over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators.balanced import TASK, balanced, per_key, placement
from tallyloom.operators.entity_features import entity_features, event_cells, feature_cells
from tallyloom.operators.records import one_per_id
from tallyloom.operators.sessions import sessions
from tallyloom.session import cut, table

SESSION_GAP = 1800.0
LARGE_SHARE = 0.01


def comment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, author, subreddit, created_utc) of comments with an author and a time above 0, one per id."""
    rows = one_per_id(table(spark, sf_dir, "comments"), author=X.author("author"), subreddit=X.community("subreddit"), created_utc=F.when(F.col("created_utc") > 0, F.col("created_utc")))
    return rows.where(F.col("author").isNotNull() & F.col("created_utc").isNotNull())


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = event_cells(comment_events(spark, sf_dir), "author", "subreddit", "created_utc")
    found = feature_cells(entity_features(cells, layout="list"))
    return found.select(F.col("entity").alias("author"), F.col("kind").alias("subreddit"), F.col("n").alias("n_comments"), F.floor("last").cast("long").alias("last_utc"))


def p1_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide feature table: for each community the number of an author's comments and the seconds since the last."""
    cells = cut(event_cells(comment_events(spark, sf_dir), "author", "subreddit", "created_utc"))
    return entity_features(cells, layout="wide").withColumnRenamed("entity", "author")


def p1_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide feature table folded to a row per author: sums over its columns, each weighted by its place, so that a value in a
    wrong column shows."""
    wide = p1_features(spark, sf_dir)
    each = lambda what: [(i + 1, F.col(f"{what}_{i}")) for i in range((len(wide.columns) - 5) // 3)]
    fold = lambda what, zero: F.aggregate(F.array(*[F.coalesce(c * i, zero) for i, c in each(what)]), zero, lambda a, x: a + x)
    return wide.select("author", "n_events", F.floor("last").cast("long").alias("last_utc"), "n_types", fold("n", F.lit(0).cast("long")).alias("n_check"), F.round(fold("total", F.lit(0.0)), 3).alias("total_check"), F.round(fold("recency", F.lit(0.0)), 0).alias("recency_check"))


def p4_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions(comment_events(spark, sf_dir), "author", "created_utc", SESSION_GAP)
    return found.select(F.col("entity").alias("author"), F.floor("start").cast("long").alias("start_utc"), F.floor("end").cast("long").alias("end_utc"), F.round("duration", 3).alias("duration"), F.col("n").alias("n_comments"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_sessions(spark, sf_dir).select("author", "start_utc", "end_utc")


def authored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(author, record, kind): rows with an author and a payload that is whole JSON and has an id."""
    doc = F.try_parse_json(F.col("payload"))
    rows = table(spark, sf_dir, "records").select(X.author("author").alias("author"), F.try_variant_get(doc, "$.id", "string").alias("record"), "kind")
    return rows.where(F.col("author").isNotNull() & F.col("record").isNotNull() & (F.col("record") != ""))


def distinct_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(author, n_records) through the balanced operator. Rows are combined to one per author and record before they are
    placed; a record under two authors belongs to the smaller."""
    rows = cut(one_per_id(authored_records(spark, sf_dir), "record", author=F.col("author"), kind=F.col("kind")))
    plan = placement(rows.groupBy(F.col("author").alias("key")).agg(F.count(F.lit(1)).alias("load")))
    return per_key(rows, "author", "record", plan).select("author", F.col("records").alias("n_records"))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_records(spark, sf_dir)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cut(distinct_records(spark, sf_dir))
    total = counts.agg(F.sum("n_records")).first()[0] or 0
    return counts.where(F.col("n_records") >= LARGE_SHARE * total).select("author")


def p6_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records joined to a per-author side (the author's comments) without one task taking a large author: per author and
    kind the distinct records beside the author's number of comments."""
    rows = cut(one_per_id(authored_records(spark, sf_dir), "record", author=F.col("author"), kind=F.col("kind")))
    plan = placement(rows.groupBy(F.col("author").alias("key")).agg(F.count(F.lit(1)).alias("load")))
    side = comment_events(spark, sf_dir).groupBy("author").agg(F.count(F.lit(1)).alias("n_comments"))
    joined = balanced(rows, "author", "record", plan, side, "left")
    return joined.groupBy(TASK, "author", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("n_comments").alias("m")).groupBy("author", "kind").agg(F.sum("n").alias("n_records"), F.coalesce(F.max("m"), F.lit(0)).alias("n_comments"))


_SPACES = "'" + X.SPACES + "'"
_NONE = ", ".join(f"'{x}'" for x in X.NO_AUTHOR)
SQL_AUTHOR = f"CASE WHEN trim(author, {_SPACES}) NOT IN ('', {_NONE}) THEN trim(author, {_SPACES}) END"
SQL_COMMUNITY = f"nullif(trim(regexp_replace(lower(trim(subreddit, {_SPACES})), '^/?r/', ''), {_SPACES}), '')"
SQL_EVENTS = f"""events_ AS (
  SELECT id, min(a) AS author, min(s) AS subreddit, min(t) AS created_utc
  FROM (SELECT id, {SQL_AUTHOR} AS a, {SQL_COMMUNITY} AS s, CASE WHEN created_utc > 0 THEN created_utc END AS t FROM comments WHERE id IS NOT NULL)
  GROUP BY id HAVING min(a) IS NOT NULL AND min(t) IS NOT NULL)"""
SQL_SESSIONS = f"""WITH {SQL_EVENTS},
s1 AS (SELECT *, CASE WHEN created_utc - lag(created_utc) OVER (PARTITION BY author ORDER BY created_utc) <= 1800 THEN 0 ELSE 1 END AS b FROM events_),
s2 AS (SELECT *, sum(b) OVER (PARTITION BY author ORDER BY created_utc ROWS UNBOUNDED PRECEDING) AS k FROM s1)
SELECT author, CAST(floor(min(created_utc)) AS BIGINT) AS start_utc, CAST(floor(max(created_utc)) AS BIGINT) AS end_utc"""
SQL_RECORDS = f"""records_ AS (
  SELECT r, min(a) AS author, min(kind) AS kind FROM (
    SELECT {SQL_AUTHOR} AS a, json_extract_string(TRY_CAST(payload AS JSON), '$.id') AS r, kind FROM records)
  WHERE a IS NOT NULL AND r IS NOT NULL AND r <> '' GROUP BY r)"""

QUERIES = {"p1_found": p1_found, "p1_features": p1_features, "p1_checks": p1_checks, "p4_found": p4_found, "p4_sessions": p4_sessions, "p6_found": p6_found, "p6_counts": p6_counts, "p6_matched": p6_matched}
SQL = {
    "p1_found": f"WITH {SQL_EVENTS} SELECT author, subreddit, count(*) AS n_comments, CAST(floor(max(created_utc)) AS BIGINT) AS last_utc FROM events_ WHERE subreddit IS NOT NULL GROUP BY 1, 2",
    "p1_checks": f"""WITH {SQL_EVENTS}, c AS (SELECT author, subreddit, count(*) AS n, max(created_utc) AS t FROM events_ WHERE subreddit IS NOT NULL GROUP BY 1, 2),
k AS (SELECT subreddit, row_number() OVER (ORDER BY subreddit) AS i FROM (SELECT DISTINCT subreddit FROM c)), m AS (SELECT max(t) AS m FROM c)
SELECT author, CAST(sum(n) AS BIGINT) AS n_events, CAST(floor(max(t)) AS BIGINT) AS last_utc, CAST(count(*) AS INT) AS n_types, CAST(sum(n * i) AS BIGINT) AS n_check, round(sum(n * i)::DOUBLE, 3) AS total_check, round(sum((m - t) * i), 0) AS recency_check FROM c JOIN k USING (subreddit), m GROUP BY author""",
    "p4_found": f"{SQL_SESSIONS} FROM s2 GROUP BY author, k",
    "p4_sessions": f"{SQL_SESSIONS}, round(max(created_utc) - min(created_utc), 3) AS duration, count(*) AS n_comments FROM s2 GROUP BY author, k",
    "p6_found": f"WITH {SQL_RECORDS} SELECT author FROM records_ GROUP BY author HAVING count(*) >= 0.01 * (SELECT count(*) FROM records_)",
    "p6_counts": f"WITH {SQL_RECORDS} SELECT author, count(*) AS n_records FROM records_ GROUP BY author",
    "p6_matched": f"""WITH {SQL_RECORDS}, {SQL_EVENTS}, c AS (SELECT author, count(*) AS n FROM events_ GROUP BY author)
SELECT r.author, r.kind, count(*) AS n_records, coalesce(max(c.n), 0) AS n_comments FROM records_ r LEFT JOIN c ON c.author = r.author GROUP BY 1, 2""",
}
