"""Queries on labels, communities, sets, samples, profiles and classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import rules as R
from tallyloom.functions import text as X
from tallyloom.operators import labels as L
from tallyloom.operators import relational as J
from tallyloom.operators import training as M
from tallyloom.operators.records import numbered
from tallyloom.operators.timing import bare_id
from tallyloom.plans import feature_queries
from tallyloom.plans.base import S, comments, planted, sql_author, sql_planted, sql_records, submissions
from tallyloom.session import cut, table

LEAST_POSTS, SURE = 3, 0.9
ACTIVE = (1000, 100)  # posts and subscribers of an active community
NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """A rank list: authors of suspicious pairs with their highest similarity."""
    pairs = table(spark, d, "suspicious_pairs")
    ends = pairs.select(X.author("author_1").alias("author"), F.col("cosine_similarity").alias("score")).union(pairs.select(X.author("author_2"), "cosine_similarity"))
    return ends.where("author IS NOT NULL").groupBy("author").agg(F.max("score").alias("score"))


def _posts(spark: SparkSession, d: str) -> DataFrame:
    c = comments(spark, d, "author", "created_utc", "author_fullname", "body").select("author", F.lit("comment").alias("kind"), "created_utc", "author_fullname", F.col("body").alias("text"))
    s = submissions(spark, d, "author", "created_utc", "author_fullname", "title", "selftext").select("author", F.lit("submission").alias("kind"), "created_utc", "author_fullname", F.concat_ws(" ", "title", "selftext").alias("text"))
    return c.union(s).where("author IS NOT NULL")


# The generated tables hold no names or phrases of automated accounts, so some are planted.
_NAME_ROWS = [(n,) for n in ("bot", "Bot", "news-bot", "newsbot", "link_bot", "bot_x", "a_bot_b", "bottom", "iron_mod", "the mod", "AutoTLDR", "auto-mat", "botswana", "my.bot", "mod")]
_PHRASE_ROWS = [("zp1", "I am a bot, beep."), ("zp2", "i'm a bottom"), ("zp3", "BEEP BOOP"), ("zp4", "This action was performed automatically."), ("zp5", "an automatic response"), ("zp6", None), ("zp7", "no I'm a bot\nreally"), ("zp8", "I am a both")]


def _patterns(authors: DataFrame) -> DataFrame:
    return authors.select("author").distinct().select("author", R.name_pattern("author", R.NOT_BOTS).alias("pattern")).where("pattern IS NOT NULL")


def name_patterns(spark: SparkSession, d: str) -> DataFrame:
    return _patterns(_posts(spark, d).select("author").union(planted(spark, _NAME_ROWS, "author string")))


def name_labels(spark: SparkSession, d: str) -> DataFrame:
    """The labelling rules on every name, and the reason."""
    names = _posts(spark, d).select("author").union(planted(spark, _NAME_ROWS, "author string")).distinct()
    return names.select("author", R.name_label("author", R.NOT_BOTS).alias("x")).select("author", "x.label", "x.reason")


def phrase_matches(spark: SparkSession, d: str) -> DataFrame:
    rows = comments(spark, d, "body").unionByName(planted(spark, _PHRASE_ROWS, "id string, body string"))
    return rows.where(R.has_phrase("body")).select("id", R.has_phrase("body", R.DIAGNOSIS_PHRASES).alias("in_diagnosis"))


def bot_authors(spark: SparkSession, d: str) -> DataFrame:
    return L.matching_authors(L.record_matches(_posts(spark, d), _ranked(spark, d).where(F.col("score") >= SURE)), LEAST_POSTS)


def human_authors(spark: SparkSession, d: str) -> DataFrame:
    return L.matching_authors(L.record_matches(_posts(spark, d), _ranked(spark, d).where(F.col("score") >= SURE)), LEAST_POSTS, humans=True)


def rule_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = L.assign_labels(L.author_statistics(_posts(spark, d)), _ranked(spark, d), LEAST_POSTS, SURE)
    return rows.select("author", "author_fullname", "label", "label_source", F.round("label_confidence", 5).alias("label_confidence"), "y", "num_comments", "num_submissions", "total_posts", "first_seen_utc", "last_seen_utc", F.round("account_span_days", 5).alias("account_span_days"), F.round("botrank_score", 5).alias("botrank_score"))


def label_summary(spark: SparkSession, d: str) -> DataFrame:
    return rule_labels(spark, d).groupBy("label", "label_source").agg(F.count(F.lit(1)).alias("n"), F.sum("total_posts").alias("posts"))


def false_positive_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    return L.diagnosis_summary(L.diagnose(_posts(spark, d), _ranked(spark, d).where(F.col("score") >= SURE)))


def label_list_changes(spark: SparkSession, d: str) -> DataFrame:
    bots = rule_labels(spark, d).where("y = 1")
    return L.compare_lists(_patterns(_posts(spark, d)), bots).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def semi_join_authors(spark: SparkSession, d: str) -> DataFrame:
    return J.keep_members(comments(spark, d, "author", "subreddit"), _ranked(spark, d), "author")


def anti_join_authors(spark: SparkSession, d: str) -> DataFrame:
    return J.drop_members(comments(spark, d, "author", "subreddit"), _ranked(spark, d), "author").where("author IS NOT NULL")


def comments_of_known_posts(spark: SparkSession, d: str) -> DataFrame:
    rows = comments(spark, d, "link_id").select("id", bare_id("link_id").alias("post"))
    return J.keep_members(rows, submissions(spark, d, "title").select(F.col("id").alias("post")), "post")


def wanted_parents(spark: SparkSession, d: str) -> DataFrame:
    """The comments that others answer: harvested parent ids, looked up."""
    rows = comments(spark, d, "author", "created_utc", "parent_id")
    wanted = rows.where(F.col("parent_id").startswith("t1_")).select(bare_id("parent_id").alias("id")).distinct()
    return J.keep_members(rows.select("id", "author", "created_utc"), wanted, "id")


def author_merge(spark: SparkSession, d: str) -> DataFrame:
    """Comments and submissions per author, either side may be missing; authors with enough posts."""
    by = _posts(spark, d).groupBy("author").agg(F.count_if(F.col("kind") == "comment").alias("n_comments"), F.count_if(F.col("kind") == "submission").alias("n_submissions"))
    return by.where(F.col("n_comments") + F.col("n_submissions") >= LEAST_POSTS)


def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    """The copy of each comment with the earliest period, unknown periods last."""
    return J.first_by(table(spark, d, "comments").select("id", "source_period", "score"), "id", ["source_period", "score"])


def upsert_last(spark: SparkSession, d: str) -> DataFrame:
    """The copy of each comment with the latest period, unknown periods last."""
    return J.first_by(table(spark, d, "comments").select("id", "source_period", "score"), "id", ["source_period", "score"], last=True)


def author_set_check(spark: SparkSession, d: str) -> DataFrame:
    """Authors of suspicious pairs that have no post, and the number of those that have."""
    posts = _posts(spark, d).select("author").distinct().withColumn("there", F.lit(True))
    return _ranked(spark, d).select("author").join(posts, "author", "left").groupBy(F.coalesce("there", F.lit(False)).alias("has_posts")).agg(F.count(F.lit(1)).alias("n"))


def sampled_authors(spark: SparkSession, d: str) -> DataFrame:
    return J.hash_sample(J.drop_members(_posts(spark, d).select("author").distinct(), _ranked(spark, d), "author"), "author", 100)


def quota_sample_by_period(spark: SparkSession, d: str) -> DataFrame:
    return J.quota_sample(table(spark, d, "comments").select("id", "source_period").distinct(), "source_period", "id", 1000)


def bernoulli_comments(spark: SparkSession, d: str) -> DataFrame:
    return J.bernoulli_sample(comments(spark, d, "author"), "id", 0.05, 5000)


def named_bot_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """Comments whose author's name doesn't hold "bot" in any case."""
    return comments(spark, d, "author").where("author IS NOT NULL").where(X.without_parts("author", ("bot", " ")))


def community_matches(spark: SparkSession, d: str) -> DataFrame:
    """Comments of the largest communities, by name or by id, and how many of each."""
    wanted = [r[0] for r in table(spark, d, "communities").where("_meta.num_posts >= 3000").select(X.community("display_name")).distinct().collect()]  # a directory that never grows
    by_id = [r[0] for r in table(spark, d, "communities").where("_meta.num_posts BETWEEN 1000 AND 2000 AND id IS NOT NULL").select(X.community(F.concat(F.lit("t5_"), F.regexp_replace("id", "^t5_", "")))).distinct().collect()]
    rows = table(spark, d, "comments").where("id IS NOT NULL").select("id", X.matched_community([*wanted, *by_id]).alias("community")).distinct()
    return rows.where("community IS NOT NULL").groupBy("community").agg(F.count(F.lit(1)).alias("n"))


def author_merge_both(spark: SparkSession, d: str) -> DataFrame:
    """Authors that have both comments and submissions, and enough of them."""
    by = _posts(spark, d).groupBy("author").agg(F.count_if(F.col("kind") == "comment").alias("n_comments"), F.count_if(F.col("kind") == "submission").alias("n_submissions"))
    return by.where((F.col("n_comments") > 0) & (F.col("n_submissions") > 0) & (F.col("n_comments") + F.col("n_submissions") >= LEAST_POSTS))


def author_list_union(spark: SparkSession, d: str) -> DataFrame:
    """The different authors of several lists, less those excluded: comments and submissions, less ranked authors."""
    lists = comments(spark, d, "author").select("author").union(submissions(spark, d, "author").select("author")).where("author IS NOT NULL").distinct()
    return J.drop_members(lists, _ranked(spark, d), "author")


def forest_importance(spark: SparkSession, d: str) -> DataFrame:
    """A forest's own importance of each feature, and which could be dropped."""
    rows = cut(prepared_features(spark, d))
    columns = [c for c in rows.columns if c not in ("author", "y", "split")]
    fitted, _ = M.train(rows, columns, M.models(len(columns), rounds=20)["forest"])
    return M.tree_importance(fitted, columns, spark)


def community_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "communities").where("display_name IS NOT NULL")
    flat = rows.select("display_name", F.col("_meta.num_posts").alias("num_posts"), F.col("_meta.num_comments").alias("num_comments"), "subscribers", "description", "public_description")
    full = J.first_by(flat.where("description IS NOT NULL"), "display_name", ["num_posts"], last=True)
    meta = J.first_by(flat.select("display_name", "num_posts", "num_comments", "subscribers", "public_description"), "display_name", ["num_posts"], last=True)
    return J.merge_right_first(meta, full, "display_name", {"description": F.lit("")}).select("display_name", "num_posts", "num_comments", "subscribers", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("public_description", F.lit("")).alias("public_description"))


def ranked_communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities with activity, by money words and subscribers."""
    rows = community_merge(spark, d).where(R.is_active("num_posts", "subscribers", *ACTIVE))
    k = R.keyword_class(R.keyword_words(F.concat_ws(" ", "display_name", "description", "public_description")))
    rows = rows.withColumn("k", k).select("display_name", F.col("k.keyword_count").alias("keyword_count"), F.col("k.is_match").alias("is_match"), "subscribers")
    return numbered(rows, [F.desc("keyword_count"), F.desc("subscribers"), F.col("display_name")]).withColumn("rank", F.col("place").cast("int")).drop("place")


def column_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = J.column_profile(table(spark, d, "lineitem"), list(NUMBERS))
    return rows.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


def correlation_pairs(spark: SparkSession, d: str) -> DataFrame:
    return J.correlations(table(spark, d, "lineitem"), list(NUMBERS)).select("a", "b", F.round("r", 6).alias("r"))


def null_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "submissions")
    each = [F.struct(F.lit(c).alias("column"), F.round(F.avg(F.col(c).isNull().cast("int")), 6).alias("null_rate")) for c in rows.columns]
    return rows.agg(F.array(*each).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "suspicious_pairs").select(F.col("cosine_similarity").alias("score"), (F.col("shared_url_count") >= 2).cast("int").alias("y")).where("score IS NOT NULL AND y IS NOT NULL")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.threshold_sweep(_scored(spark, d)))


def binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.metrics(_scored(spark, d), 0.8))


def curve_points(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(M.curve_points(_scored(spark, d)))


def _table(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    rows = feature_queries.activity_features(spark, d).join(feature_queries.engagement_features(spark, d), "author").join(feature_queries.community_features(spark, d), "author", "left").join(feature_queries.username_features(spark, d), "author")
    rows = rows.join(_ranked(spark, d).select("author", F.lit(1).alias("y")), "author", "left").withColumn("y", F.coalesce("y", F.lit(0)))
    return cut(rows), [c for c in rows.columns if c not in ("author", "y")]


def prepared_features(spark: SparkSession, d: str) -> DataFrame:
    """Features clipped, split, imputed and scaled."""
    rows, columns = _table(spark, d)
    rows = cut(M.stratified_split(M.clip(rows, columns)))
    fit = F.col("split") == "train"
    return M.standardize(cut(M.impute(rows, columns, fit)), columns, fit)


def model_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A forest on the features: metrics by split at the threshold chosen on the validation part."""
    rows = cut(prepared_features(spark, d))
    columns = [c for c in rows.columns if c not in ("author", "y", "split")]
    _, scored = M.train(rows, columns, M.models(len(columns), rounds=20)["forest"])
    scored = cut(scored)
    at = M.best_threshold(M.threshold_sweep(scored.where("split = 'validation'")))
    out = None
    for s in ("train", "validation", "test"):
        row = M.metrics(scored.where(F.col("split") == s), at).select(F.lit("forest").alias("model"), F.lit(s).alias("split"), "*")
        out = row if out is None else out.union(row)
    return out


_POSTS = sql_records("comments", "c0", "author", "created_utc", "author_fullname", "body") + ", " + sql_records("submissions", "s0", "author", "created_utc", "author_fullname", "title", "selftext") + """,
po AS (SELECT author, 'comment' AS kind, created_utc, author_fullname, body AS text FROM c0 WHERE author IS NOT NULL UNION ALL SELECT author, 'submission', created_utc, author_fullname, concat_ws(' ', title, selftext) FROM s0 WHERE author IS NOT NULL)"""
_RANKED = f"""rk AS (SELECT author, max(score) AS score FROM (SELECT {sql_author('author_1')} AS author, cosine_similarity AS score FROM suspicious_pairs UNION ALL SELECT {sql_author('author_2')}, cosine_similarity FROM suspicious_pairs) WHERE author IS NOT NULL GROUP BY 1)"""
_NOT = ", ".join(f"'{x}'" for x in R.NOT_BOTS)


def _norm(c: str) -> str:
    return f"nullif(trim(regexp_replace(lower(trim({c}, {S})), '^/?r/', ''), {S}), '')"


def _sql_pattern(a: str, guard: bool) -> str:
    g = f"WHEN lower({a}) IN ({_NOT}) THEN NULL " if guard else ""
    return f"CASE {g}WHEN lower({a}) = 'bot' THEN 'exact' WHEN regexp_matches(lower({a}), '\\bbot\\b') THEN 'bot' WHEN regexp_matches(lower({a}), '\\bmod\\b') THEN 'mod' WHEN regexp_matches(lower({a}), '(^bot_|_bot$|_bot_)') THEN '_bot' END"


def _sql_phrase(t: str, phrases: tuple[str, ...]) -> str:
    either = "|".join(p.replace("'", "''") for p in phrases)
    return f"coalesce(regexp_matches(lower({t}), '\\b(?:{either})\\b'), false)"


_MATCH = f"ma AS (SELECT po.author, {_sql_pattern('po.author', False)} IS NOT NULL OR lower(po.author) IN (SELECT lower(author) FROM rk WHERE score >= {SURE}) OR {_sql_phrase('text', R.PHRASES)} AS hit FROM po)"
_STATS = f"""st AS (SELECT author, count(*) FILTER (kind = 'comment') AS num_comments, count(*) FILTER (kind = 'submission') AS num_submissions, count(*) AS total_posts, min(created_utc) AS first_seen_utc, max(created_utc) AS last_seen_utc FROM po GROUP BY 1 HAVING count(*) >= {LEAST_POSTS}),
fn AS (SELECT author, author_fullname FROM po WHERE author_fullname <> '' QUALIFY row_number() OVER (PARTITION BY author ORDER BY kind, created_utc NULLS FIRST, author_fullname) = 1),
sc AS (SELECT lower(author) AS low, max(score) AS score FROM rk GROUP BY 1),
lb0 AS (SELECT st.*, fn.author_fullname, sc.score AS s, CASE WHEN lower(st.author) = 'bot' OR (regexp_matches(lower(st.author), '\\bbot\\b') AND lower(st.author) NOT IN ({_NOT})) OR st.author LIKE 'Auto%' OR regexp_matches(lower(st.author), '\\bauto\\b') OR regexp_matches(lower(st.author), '\\bmod\\b') OR regexp_matches(lower(st.author), '(^bot_|_bot$|_bot_)') THEN 'bot' ELSE 'human' END AS rule FROM st LEFT JOIN fn USING (author) LEFT JOIN sc ON sc.low = lower(st.author)),
lb AS (SELECT author, author_fullname, CASE WHEN s >= {SURE} THEN 'bot' ELSE rule END AS label, CASE WHEN s >= {SURE} THEN 'botrank' ELSE 'rule' END AS label_source, CASE WHEN s >= {SURE} THEN round(s, 5) ELSE 1.0 END AS label_confidence, CASE WHEN s >= {SURE} OR rule = 'bot' THEN 1 ELSE 0 END AS y, num_comments, num_submissions, total_posts, first_seen_utc, last_seen_utc, round(coalesce((last_seen_utc - first_seen_utc) / 86400.0, 0), 5) AS account_span_days, round(s, 5) AS botrank_score FROM lb0)"""
_ALL = f"WITH {_POSTS}, {_RANKED}"
_C1 = "WITH " + sql_records("comments", "c0", "author", "subreddit", "link_id", "parent_id", "created_utc") + ", " + sql_records("submissions", "s0", "title")
_MERGE = """fl AS (SELECT display_name, _meta.num_posts AS num_posts, _meta.num_comments AS num_comments, subscribers, description, public_description FROM communities WHERE display_name IS NOT NULL),
fu AS (SELECT * FROM fl WHERE description IS NOT NULL QUALIFY row_number() OVER (PARTITION BY display_name ORDER BY num_posts DESC NULLS LAST, num_comments DESC NULLS LAST, subscribers DESC NULLS LAST, description DESC NULLS LAST, public_description DESC NULLS LAST) = 1),
me AS (SELECT display_name, num_posts, num_comments, subscribers, public_description FROM fl QUALIFY row_number() OVER (PARTITION BY display_name ORDER BY num_posts DESC NULLS LAST, num_comments DESC NULLS LAST, subscribers DESC NULLS LAST, public_description DESC NULLS LAST) = 1),
mg AS (SELECT display_name, num_posts, num_comments, subscribers, coalesce(description, '') AS description, coalesce(public_description, '') AS public_description FROM fu UNION ALL SELECT display_name, num_posts, num_comments, subscribers, '', coalesce(public_description, '') FROM me WHERE display_name NOT IN (SELECT display_name FROM fu))"""
_KEYS = ", ".join(f"'{x}'" for x in R.MONEY_WORDS)
_BAD = ", ".join(f"'{x}'" for x in R.NOT_MONEY_WORDS)
_COPIES = "SELECT id, source_period, score FROM comments WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY source_period {0} NULLS LAST, score {0} NULLS LAST) = 1"
_SC = "sc AS (SELECT cosine_similarity AS score, CASE WHEN shared_url_count >= 2 THEN 1 ELSE 0 END AS y FROM suspicious_pairs WHERE cosine_similarity IS NOT NULL AND shared_url_count IS NOT NULL)"


def _sql_confusion(thresholds: str) -> str:
    return f"""cf AS (SELECT t AS threshold, count(*) FILTER (score >= t AND y = 1) AS tp, count(*) FILTER (score >= t AND y = 0) AS fp, count(*) FILTER (score < t AND y = 1) AS fn, count(*) FILTER (score < t AND y = 0) AS tn FROM sc, (SELECT unnest([{thresholds}]::DOUBLE[]) AS t) GROUP BY 1),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM cf),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM pr)"""


_LV = "lv AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM sc GROUP BY 1), cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS pp, sum(neg) OVER () AS nn FROM lv WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"

QUERIES = {f.__name__: f for f in (name_patterns, name_labels, phrase_matches, bot_authors, human_authors, rule_labels, label_summary, false_positive_diagnosis, label_list_changes, semi_join_authors, anti_join_authors, comments_of_known_posts, wanted_parents, author_merge, dedup_first, upsert_last, author_set_check, sampled_authors, quota_sample_by_period, bernoulli_comments, named_bot_exclusion, community_matches, author_merge_both, author_list_union, community_merge, ranked_communities, column_profile, correlation_pairs, null_rates, threshold_sweep, binary_metrics, curve_points, prepared_features, model_metrics, forest_importance)}
SQL = {
    "name_patterns": f"{_ALL} SELECT * FROM (SELECT author, {_sql_pattern('author', True)} AS pattern FROM (SELECT author FROM po UNION SELECT author FROM {sql_planted(_NAME_ROWS, 'author string')})) WHERE pattern IS NOT NULL",
    "name_labels": f"""{_ALL}, n AS (SELECT author, lower(author) AS low FROM (SELECT author FROM po UNION SELECT author FROM {sql_planted(_NAME_ROWS, 'author string')})),
r AS (SELECT author, CASE WHEN low = 'bot' THEN 'exact' WHEN regexp_matches(low, '\\bbot\\b') AND low NOT IN ({_NOT}) THEN 'whole word bot' WHEN starts_with(author, 'Auto') THEN 'starts with Auto' WHEN regexp_matches(low, '\\bauto\\b') THEN 'whole word auto' WHEN regexp_matches(low, '\\bmod\\b') THEN 'whole word mod' WHEN regexp_matches(low, '(^bot_|_bot$|_bot_)') THEN 'parted bot' END AS why FROM n)
SELECT author, CASE WHEN why IS NULL THEN 'human' ELSE 'bot' END AS label, coalesce(why, 'no pattern') AS reason FROM r""",
    "phrase_matches": f"WITH {sql_records('comments', 'c1', 'body')}, c0 AS (SELECT id, body FROM c1 UNION ALL SELECT id, body FROM {sql_planted(_PHRASE_ROWS, 'id string, body string')}) SELECT id, {_sql_phrase('body', R.DIAGNOSIS_PHRASES)} AS in_diagnosis FROM c0 WHERE {_sql_phrase('body', R.PHRASES)}",
    "bot_authors": f"{_ALL}, {_MATCH} SELECT author, count(*) AS n_posts FROM ma WHERE hit GROUP BY 1 HAVING count(*) >= {LEAST_POSTS}",
    "human_authors": f"{_ALL}, {_MATCH} SELECT author, count(*) AS n_posts FROM ma WHERE NOT hit GROUP BY 1 HAVING count(*) >= {LEAST_POSTS}",
    "rule_labels": f"{_ALL}, {_STATS} SELECT * FROM lb",
    "label_summary": f"{_ALL}, {_STATS} SELECT label, label_source, count(*) AS n, CAST(sum(total_posts) AS BIGINT) AS posts FROM lb GROUP BY 1, 2",
    "false_positive_diagnosis": f"""{_ALL}, d AS (SELECT author, CASE WHEN {_sql_pattern('author', True)} IS NOT NULL THEN 'A' WHEN lower(author) IN (SELECT lower(author) FROM rk WHERE score >= {SURE}) THEN 'B' WHEN sum(CASE WHEN {_sql_phrase('text', R.DIAGNOSIS_PHRASES)} THEN 1 ELSE 0 END) > 0 THEN 'C' ELSE 'none' END AS rule FROM po GROUP BY author),
n AS (SELECT rule, count(*) AS n, (SELECT count(*) FROM d)::DOUBLE AS m FROM d GROUP BY 1)
SELECT rule, n, round(n / m, 5) AS rate, round((n / m + 1.9208 / m - 1.96 * sqrt(n / m * (1 - n / m) / m + 3.8416 / (4 * m * m))) / (1 + 3.8416 / m), 5) AS low, round((n / m + 1.9208 / m + 1.96 * sqrt(n / m * (1 - n / m) / m + 3.8416 / (4 * m * m))) / (1 + 3.8416 / m), 5) AS high FROM n""",
    "label_list_changes": f"""{_ALL}, {_STATS}, x AS (SELECT author FROM (SELECT author, {_sql_pattern('author', True)} AS p FROM (SELECT DISTINCT author FROM po)) WHERE p IS NOT NULL), y AS (SELECT author FROM lb WHERE y = 1)
SELECT change, count(*) AS n FROM (SELECT CASE WHEN x.author IS NOT NULL AND y.author IS NOT NULL THEN 'kept' WHEN y.author IS NOT NULL THEN 'added' ELSE 'eliminated' END AS change FROM x FULL JOIN y ON x.author = y.author) GROUP BY 1""",
    "semi_join_authors": f"WITH {sql_records('comments', 'c0', 'author', 'subreddit')}, {_RANKED} SELECT * FROM c0 WHERE author IN (SELECT author FROM rk)",
    "anti_join_authors": f"WITH {sql_records('comments', 'c0', 'author', 'subreddit')}, {_RANKED} SELECT * FROM c0 WHERE author IS NOT NULL AND author NOT IN (SELECT author FROM rk)",
    "comments_of_known_posts": f"{_C1} SELECT id, regexp_replace(link_id, '^t[123]_', '') AS post FROM c0 WHERE regexp_replace(link_id, '^t[123]_', '') IN (SELECT id FROM s0)",
    "wanted_parents": f"WITH {sql_records('comments', 'c0', 'author', 'created_utc', 'parent_id')} SELECT id, author, created_utc FROM c0 WHERE id IN (SELECT substr(parent_id, 4) FROM c0 WHERE starts_with(parent_id, 't1_'))",
    "author_merge": f"WITH {_POSTS} SELECT author, count(*) FILTER (kind = 'comment') AS n_comments, count(*) FILTER (kind = 'submission') AS n_submissions FROM po GROUP BY 1 HAVING count(*) >= {LEAST_POSTS}",
    "author_merge_both": f"WITH {_POSTS} SELECT author, count(*) FILTER (kind = 'comment') AS n_comments, count(*) FILTER (kind = 'submission') AS n_submissions FROM po GROUP BY 1 HAVING count(*) >= {LEAST_POSTS} AND count(DISTINCT kind) = 2",
    "author_list_union": f"{_ALL} SELECT DISTINCT author FROM po WHERE author NOT IN (SELECT author FROM rk)",
    "community_matches": f"""WITH n AS (SELECT id, {_norm('subreddit')} AS a, {_norm('subreddit_id')} AS b FROM comments WHERE id IS NOT NULL),
k AS (SELECT {_norm('display_name')} AS k FROM communities WHERE _meta.num_posts >= 3000 UNION SELECT {_norm("'t5_' || regexp_replace(id, '^t5_', '')")} FROM communities WHERE _meta.num_posts BETWEEN 1000 AND 2000 AND id IS NOT NULL)
SELECT community, count(*) AS n FROM (SELECT DISTINCT id, CASE WHEN a IN (SELECT k FROM k) THEN a WHEN b IN (SELECT k FROM k) THEN b END AS community FROM n) WHERE community IS NOT NULL GROUP BY 1""",
    "dedup_first": _COPIES.format("ASC"),
    "upsert_last": _COPIES.format("DESC"),
    "author_set_check": f"{_ALL} SELECT author IN (SELECT author FROM po) AS has_posts, count(*) AS n FROM rk GROUP BY 1",
    "named_bot_exclusion": f"WITH {sql_records('comments', 'c0', 'author')} SELECT id, author FROM c0 WHERE author IS NOT NULL AND NOT contains(lower(author), 'bot')",
    "community_merge": f"WITH {_MERGE} SELECT * FROM mg",
    "ranked_communities": f"""WITH {_MERGE}, w AS (SELECT display_name, subscribers, list_distinct(list_filter([trim(x, '.,!?-_()[]{{}}":;') for x in string_split(trim(regexp_replace(lower(concat_ws(' ', display_name, description, public_description)), '[\\s\\x{{a0}}]+', ' ', 'g')), ' ')], lambda v: v <> '')) AS ws FROM mg WHERE num_posts >= {ACTIVE[0]} AND subscribers >= {ACTIVE[1]}),
k AS (SELECT display_name, subscribers, len(list_filter(ws, lambda v: v IN ({_KEYS}) AND v NOT IN ({_BAD})))::INT AS keyword_count, len(list_filter(ws, lambda v: v IN ({_BAD}))) AS bad FROM w)
SELECT display_name, keyword_count, keyword_count > 0 AND bad = 0 AS is_match, subscribers, CAST(row_number() OVER (ORDER BY keyword_count DESC, subscribers DESC, display_name) AS INT) AS rank FROM k""",
    "column_profile": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS nulls, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4)::DOUBLE AS min, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q75, round(max({c}), 4)::DOUBLE AS max, count(*) FILTER ({c} < 0) AS negatives FROM lineitem" for c in NUMBERS),
    "correlation_pairs": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]),
    "null_rates": "SELECT \"column\", round(r, 6) AS null_rate FROM (UNPIVOT (SELECT avg(CASE WHEN COLUMNS(*) IS NULL THEN 1.0 ELSE 0.0 END) FROM submissions) ON COLUMNS(*) INTO NAME \"column\" VALUE r)",
    "threshold_sweep": f"WITH {_SC}, {_sql_confusion(', '.join(map(str, M.THRESHOLDS)))} SELECT threshold, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM f",
    "binary_metrics": f"""WITH {_SC}, {_LV}, {_sql_confusion('0.8')}, a AS (SELECT sum(pos * (nn - fp + neg / 2.0)) / (any_value(pp) * any_value(nn)) AS auc, sum(pos * tp / (tp + fp)) / any_value(pp) AS ap FROM cu),
k AS (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS o, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn)) AS e FROM f)
SELECT threshold, round(auc, 6) AS roc_auc, round(ap, 6) AS pr_auc, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, round(CASE WHEN e < 1 THEN (o - e) / (1 - e) ELSE 0 END, 6) AS kappa, round(fp / (fp + tn), 6) AS fpr, round(fn / (fn + tp), 6) AS fnr, tp, fp, fn, tn FROM k, a""",
    "curve_points": f"WITH {_SC}, {_LV} SELECT round(score, 6) AS threshold, round(tp / pp, 6) AS tpr, round(fp / nn, 6) AS fpr, round(tp / (tp + fp), 6) AS precision FROM cu",
}
