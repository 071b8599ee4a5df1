"""Queries on per-author features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.urls import URL_FEATURES
from tallyloom.operators import features as G
from tallyloom.operators.timing import bare_id
from tallyloom.plans.base import comments, sql_records, submissions
from tallyloom.session import stored

_C = ("author", "subreddit", "created_utc", "score", "body", "controversiality", "banned_at_utc", "parent_id")
_S = ("author", "subreddit", "created_utc", "score", "title", "selftext", "url", "upvote_ratio", "num_comments", "removed_by_category", "over_18", "banned_at_utc")
WHITELIST = 20


def _c(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    rows = comments(spark, d, *(columns or _C)).where("author IS NOT NULL")
    return rows.withColumn("parent", F.when(F.col("parent_id").startswith("t1_"), bare_id("parent_id"))) if "parent_id" in rows.columns else rows


def _s(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return submissions(spark, d, *(columns or _S)).where("author IS NOT NULL")


def _round(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.select(*[F.round(c, -3 if c.endswith("_variance") else digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def activity_features(spark: SparkSession, d: str) -> DataFrame:
    return _round(G.activity(_c(spark, d, "author", "created_utc"), _s(spark, d, "author", "created_utc")))


def interval_features(spark: SparkSession, d: str) -> DataFrame:
    return _round(G.intervals(_c(spark, d, "author", "created_utc"), _s(spark, d, "author", "created_utc")), 3)


def _reply(spark: SparkSession, d: str, mode: str) -> DataFrame:
    rows = comments(spark, d, "author", "created_utc", "parent_id")
    rows = rows.withColumn("parent", F.when(F.col("parent_id").startswith("t1_"), bare_id("parent_id")))
    return _round(G.reply_times(rows.where("author IS NOT NULL"), rows.select("id", "created_utc"), mode), 3)


def reply_time_features(spark: SparkSession, d: str) -> DataFrame:
    return _reply(spark, d, "per_parent_last")


def reply_time_features_v1(spark: SparkSession, d: str) -> DataFrame:
    return _reply(spark, d, "per_reply")


def engagement_features(spark: SparkSession, d: str) -> DataFrame:
    return _round(G.engagement(_c(spark, d, "author", "score"), _s(spark, d, "author", "score", "upvote_ratio", "num_comments")))


def moderation_features(spark: SparkSession, d: str) -> DataFrame:
    return _round(G.moderation(_c(spark, d, "author", "banned_at_utc", "controversiality"), _s(spark, d, "author", "banned_at_utc", "removed_by_category")))


def community_features(spark: SparkSession, d: str) -> DataFrame:
    return _round(G.communities(_c(spark, d, "author", "subreddit"), _s(spark, d, "author", "subreddit", "over_18")))


def text_stylometrics(spark: SparkSession, d: str) -> DataFrame:
    return _round(G.stylometry(_c(spark, d, "author", "body"), _s(spark, d, "author", "title", "selftext")))


def domain_whitelist(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent domains of all URLs and what they cover."""
    counts = G.author_urls(_c(spark, d, "author", "body"), _s(spark, d, "author", "selftext", "url")).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return _round(G.domain_coverage(counts))


def url_features(spark: SparkSession, d: str) -> DataFrame:
    known = domain_whitelist(spark, d).where(F.col("rank") <= WHITELIST).select("domain")
    return _round(G.links(_c(spark, d, "author", "body"), _s(spark, d, "author", "selftext", "url"), known))


def username_features(spark: SparkSession, d: str) -> DataFrame:
    return _round(G.names(_c(spark, d, "author").select("author").union(_s(spark, d, "author").select("author"))))


def author_features(spark: SparkSession, d: str) -> DataFrame:
    """All feature groups in one table, for authors that commented."""
    rows = stored(comments(spark, d, *_C).withColumn("parent", F.when(F.col("parent_id").startswith("t1_"), bare_id("parent_id"))))
    c, s = rows.where("author IS NOT NULL"), stored(_s(spark, d))
    who = c.select("author").distinct()
    parents = rows.select("id", "created_utc")
    known = G.domain_coverage(G.author_urls(c, s).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))).where(F.col("rank") <= WHITELIST).select("domain")
    fine = [G.activity(c, s), G.engagement(c, s), G.moderation(c, s), G.communities(c, s), G.stylometry(c, s), G.links(c, s, known), G.names(who)]
    coarse = [G.intervals(c, s), G.reply_times(c, parents)]
    return G.join_features([who, *map(_round, fine), *(_round(g, 3) for g in coarse)])


_CS = sql_records("comments", "c0", *_C) + ", c AS (SELECT * FROM c0 WHERE author IS NOT NULL), " + sql_records("submissions", "s0", *_S) + ", s AS (SELECT * FROM s0 WHERE author IS NOT NULL)"
_URL = URL_FEATURES.replace("\\'", "'").replace("'", "''")


def _entropy(x: str) -> str:
    """Differential entropy of the sorted list x, as SQL."""
    n, m = f"len({x})", f"CAST(floor(sqrt(len({x})) + 0.5) AS INT)"
    ln = lambda e: f"(CASE WHEN {e} > 0 THEN ln({e}) ELSE '-infinity'::DOUBLE END)"
    van = f"list_sum([{ln(f'({n} + 1.0) / {m} * ({x}[i + {m}] - {x}[i])')} for i in range(1, {n} - {m} + 1)]) / ({n} - {m}) + list_sum([1.0 / k for k in range({m}, {n} + 1)]) + ln({m}) - ln({n} + 1.0)"
    weight = f"(CASE WHEN i <= {m} THEN 1 + (i - 1.0) / {m} WHEN i > {n} - {m} THEN 1 + ({n} - i) / ({m} * 1.0) ELSE 2.0 END)"
    gap = f"({x}[least(i + {m}, {n})] - {x}[greatest(i - {m}, 1)])"
    ebr = f"list_sum([{ln(f'{n} * 1.0 / ({weight} * {m}) * {gap}')} for i in range(1, {n} + 1)]) / {n}"
    vas = f"list_sum([{ln(f'{n} / (2.0 * {m}) * {gap}')} for i in range(1, {n} + 1)]) / {n}"
    return f"CASE WHEN {n} < 5 THEN NULL WHEN {n} <= 10 THEN {van} WHEN {n} <= 1000 THEN {ebr} ELSE {vas} END"


def _gap_sql(name: str, source: str) -> str:
    return f"""{name}0 AS (SELECT author, created_utc - lag(created_utc) OVER (PARTITION BY author ORDER BY created_utc) AS g FROM ({source}) WHERE created_utc IS NOT NULL AND created_utc <> 0),
{name}1 AS (SELECT author, avg(g) AS mean_, min(g) AS min_, stddev_pop(g) AS std_, var_samp(g) AS var_, list_sort(list(g)) AS x FROM {name}0 WHERE g IS NOT NULL GROUP BY author),
{name} AS (SELECT author, round(mean_, 3) AS {name}_mean_interval_seconds, round(min_, 3) AS {name}_min_interval_seconds, round(std_, 3) AS {name}_std_interval_seconds, round(var_, -3) AS {name}_interval_variance, round({_entropy('x')}, 3) AS {name}_interval_entropy FROM {name}1)"""


def _reply_sql(source: str) -> str:
    return f"""WITH {_CS}, r AS ({source}),
t AS (SELECT r.author, CASE WHEN r.created_utc >= c0.created_utc THEN r.created_utc - c0.created_utc END AS t FROM r LEFT JOIN c0 ON c0.id = r.parent),
g AS (SELECT author, avg(t) AS m, min(t) AS lo, stddev_pop(t) AS sd, var_samp(t) AS v, list_sort(list(t) FILTER (t IS NOT NULL)) AS x, count(t) / count(*) AS cov FROM t GROUP BY author)
SELECT author, round(m, 3) AS mean_reply_time_seconds, round(lo, 3) AS min_reply_time_seconds, round(sd, 3) AS std_reply_time_seconds, round(v, -3) AS reply_time_variance, round(cov, 3) AS reply_time_coverage, round({_entropy('x')}, 3) AS reply_time_entropy FROM g"""


_REPLIES = "SELECT author, regexp_replace(parent_id, '^t1_', '') AS parent, created_utc FROM c WHERE starts_with(parent_id, 't1_') AND created_utc IS NOT NULL"
_NETLOC = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1))"
_DOMAINS = f"""u AS (SELECT author, unnest(regexp_extract_all(body, '{_URL}')) AS url FROM c UNION ALL SELECT author, unnest(regexp_extract_all(selftext, '{_URL}')) FROM s UNION ALL SELECT author, url FROM s WHERE starts_with(url, 'http')),
d AS (SELECT author, ltrim({_NETLOC}, 'w.') AS domain FROM u WHERE ltrim({_NETLOC}, 'w.') <> ''),
w0 AS (SELECT domain, count(*) AS n FROM d GROUP BY 1),
w1 AS (SELECT *, row_number() OVER o AS rank, sum(n) OVER (ORDER BY n DESC, domain ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER () AS total FROM w0 WINDOW o AS (ORDER BY n DESC, domain))"""
_TEXTS = """t AS (SELECT author, body AS text FROM c WHERE body <> '' AND body NOT IN ('[deleted]', '[removed]') UNION ALL
  SELECT author, text FROM (SELECT author, trim(coalesce(title, '') || ' ' || coalesce(CASE WHEN selftext NOT IN ('[deleted]', '[removed]') THEN selftext END, '')) AS text FROM s) WHERE text <> '')"""
_BOTH = "b AS (SELECT author, 'c' AS k, created_utc, score, subreddit, banned_at_utc, controversiality, NULL AS upvote_ratio, NULL AS num_comments, NULL AS removed_by_category, NULL AS over_18 FROM c UNION ALL SELECT author, 's', created_utc, score, subreddit, banned_at_utc, NULL, upvote_ratio, num_comments, removed_by_category, over_18 FROM s)"
_ENTROPY = "round(greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0), 5)"

QUERIES = {f.__name__: f for f in (activity_features, interval_features, reply_time_features, reply_time_features_v1, engagement_features, moderation_features, community_features, text_stylometrics, domain_whitelist, url_features, username_features, author_features)}
SQL = {
    "activity_features": f"""WITH {_CS}, {_BOTH}, g AS (SELECT author, count(*) FILTER (k = 'c') AS num_comments, count(*) FILTER (k = 's') AS num_submissions, coalesce((max(created_utc) - min(created_utc)) / 86400.0, 0) AS days FROM b GROUP BY author)
SELECT author, num_comments, num_submissions, num_comments + num_submissions AS total_posts, round(num_comments / greatest(days, 1.0), 5) AS comments_per_day, round(num_submissions / greatest(days, 1.0), 5) AS submissions_per_day, round(days, 5) AS account_age_days FROM g""",
    "interval_features": f"WITH {_CS}, {_gap_sql('comment', 'SELECT author, created_utc FROM c')}, {_gap_sql('submission', 'SELECT author, created_utc FROM s')}, {_gap_sql('all_posts', 'SELECT author, created_utc FROM c UNION ALL SELECT author, created_utc FROM s')} SELECT * FROM comment FULL JOIN submission USING (author) FULL JOIN all_posts USING (author)",
    "reply_time_features": _reply_sql(f"SELECT author, parent, max(created_utc) AS created_utc FROM ({_REPLIES}) GROUP BY 1, 2"),
    "reply_time_features_v1": _reply_sql(_REPLIES),
    "engagement_features": f"""WITH {_CS}, {_BOTH}, g AS (SELECT author, avg(score) FILTER (k = 'c') AS a, avg(score) FILTER (k = 's') AS b, avg(upvote_ratio) AS u, avg(num_comments) AS n FROM b GROUP BY author)
SELECT author, round(a, 5) AS mean_comment_score, round(b, 5) AS mean_submission_score, round(u, 5) AS mean_upvote_ratio, round(n, 5) AS mean_comments_received_per_submission, round(a / (abs(b) + 1), 5) AS comment_to_post_score_ratio FROM g""",
    "moderation_features": f"""WITH {_CS}, {_BOTH} SELECT author, round(avg(CASE WHEN banned_at_utc IS NOT NULL THEN 1 ELSE 0 END), 5) AS banned_post_ratio,
round(count(*) FILTER (k = 's' AND removed_by_category = 'moderator') / greatest(count(*) FILTER (k = 's'), 1), 5) AS submission_mod_removed_ratio, round(avg(CASE WHEN k = 'c' THEN coalesce(controversiality, 0) END), 5) AS controversiality_mean FROM b GROUP BY author""",
    "community_features": f"""WITH {_CS}, {_BOTH}, n AS (SELECT author, subreddit, count(*) AS n FROM b WHERE subreddit IS NOT NULL GROUP BY 1, 2),
a AS (SELECT author, round(count(*) FILTER (k = 's' AND over_18) / greatest(count(*) FILTER (k = 's'), 1), 5) AS nsfw_subreddit_ratio FROM b GROUP BY 1)
SELECT author, count(*) AS num_unique_subreddits, round(max(n) / sum(n), 5) AS top_subreddit_concentration, {_ENTROPY} AS subreddit_entropy, any_value(nsfw_subreddit_ratio) AS nsfw_subreddit_ratio FROM n JOIN a USING (author) GROUP BY author""",
    "domain_whitelist": f"WITH {_CS}, {_DOMAINS} SELECT domain, n, rank, round(upto / total, 5) AS coverage, (upto - n) / total < 0.9 AS needed FROM w1",
    "url_features": f"""WITH {_CS}, {_DOMAINS}, n AS (SELECT author, domain, count(*) AS n FROM d GROUP BY 1, 2)
SELECT author, round(sum(CASE WHEN domain IN (SELECT domain FROM w1 WHERE rank <= {WHITELIST}) THEN 0 ELSE n END) / sum(n), 5) AS suspicious_url_ratio, {_ENTROPY} AS url_domain_entropy FROM n GROUP BY author""",
    "username_features": f"""WITH {_CS}, a AS (SELECT DISTINCT author FROM (SELECT author FROM c UNION ALL SELECT author FROM s)), x AS (SELECT author, unnest(string_split(lower(author), '')) AS ch FROM a), y AS (SELECT author, ch, count(*) AS n FROM x WHERE ch <> '' GROUP BY 1, 2), e AS (SELECT author, {_ENTROPY} AS username_entropy FROM y GROUP BY 1)
SELECT author, length(author) AS username_length, round(len(regexp_extract_all(author, '[0-9]')) / greatest(length(author), 1), 5) AS username_digit_ratio, username_entropy, regexp_matches(author, '[0-9]$')::INT AS username_has_digits_at_end, contains(author, '_')::INT AS username_has_underscore FROM a JOIN e USING (author)""",
    "text_stylometrics": f"""WITH {_CS}, {_TEXTS},
f AS (SELECT author, text, length(text) AS len, len(regexp_extract_all(text, '\\p{{Lu}}')) AS up, len(regexp_extract_all(lower(text), '\\p{{L}}')) AS letters, len(regexp_extract_all(text, '{_URL}')) AS urls, length(text) - length(replace(text, '^', '')) AS carets, length(text) - length(replace(text, '*', '')) AS stars,
  coalesce(list_max([length(r) for r in regexp_extract_all(text, '\\^+')]), 0) AS cr, coalesce(list_max([length(r) for r in regexp_extract_all(text, '\\*+')]), 0) AS sr, row_number() OVER () AS k FROM t),
ws AS (SELECT k, unnest(regexp_extract_all(text, '[\\s\\x{{0b}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+')) AS r FROM f),
wc AS (SELECT k, r, count(*) AS n FROM ws GROUP BY 1, 2), we AS (SELECT k, greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0) + 0 AS e FROM wc GROUP BY 1),
g AS (SELECT author, round(avg(len), 5) AS mean_text_length, round(sum(up) / greatest(sum(letters), 1), 5) AS uppercase_ratio, round(avg(urls), 5) AS url_density, round(avg(carets), 5) AS caret_count_mean, round(avg(stars), 5) AS asterisk_count_mean, max(cr) AS max_consecutive_carets, max(sr) AS max_consecutive_asterisks, round(avg(coalesce(e, 0)), 5) AS whitespace_entropy FROM f LEFT JOIN we USING (k) GROUP BY author),
rp AS (SELECT author, round(sum(n - 1) / sum(n), 5) AS repetition_ratio FROM (SELECT author, lower(trim(text)) AS x, count(*) AS n FROM t GROUP BY 1, 2) GROUP BY author),
tw AS (SELECT author, unnest(regexp_extract_all(regexp_replace(lower(text), '[À-ɏ]', '_', 'g'), '\\b[a-z]+\\b')) AS w FROM t),
tt AS (SELECT author, round(count(DISTINCT w) / count(*), 5) AS type_token_ratio FROM tw GROUP BY author)
SELECT g.*, coalesce(type_token_ratio, 0) AS type_token_ratio, repetition_ratio FROM g LEFT JOIN tt USING (author) LEFT JOIN rp USING (author)""",
}
_GROUPS = ("activity", "engagement", "moderation", "community", "text_stylometrics", "url", "username", "interval", "reply_time")
SQL["author_features"] = f"WITH {_CS} SELECT * FROM (SELECT DISTINCT author FROM c) " + " ".join(f"LEFT JOIN ({SQL[g if g in SQL else g + '_features']}) AS {g}_ USING (author)" for g in _GROUPS)
