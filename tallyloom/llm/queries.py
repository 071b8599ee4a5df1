"""Queries p2, p3, p5 and p7 to p10, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.llm import corpus_queries
from tallyloom.llm.distinctive import term_distinctiveness
from tallyloom.llm.near_copies import copy_groups, copy_pairs, near_copies
from tallyloom.llm.seed_tree import group_matches
from tallyloom.llm.vantage import nearest
from tallyloom.operators.records import one_per_id
from tallyloom.plans.large import SQL_COMMUNITY
from tallyloom.session import table

NEIGHBOURS = 10
ALIKE = 0.85
COPIES = 64
MIN_LINKS = 5
TOP_DOMAINS = 3


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = nearest(table(spark, sf_dir, "comment_vectors"), "vec_id", "vec", NEIGHBOURS, ALIKE, factor=0.2, shard_factor=0.07)
    return best.select(F.least("vec_id", "neighbour").alias("vec_id_1"), F.greatest("vec_id", "neighbour").alias("vec_id_2")).distinct()


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 50, however far, searched in all vectors."""
    best = nearest(table(spark, sf_dir, "comment_vectors"), "vec_id", "vec", NEIGHBOURS, -1.0, factor=0.4, queries=F.col("vec_id") % 50 == 0)
    return best.select("vec_id", "neighbour", F.round("similarity", 6).alias("similarity"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, text) of comments and submissions."""
    comments = table(spark, sf_dir, "comments").select(F.concat(F.lit("t1_"), "id").alias("name"), F.col("body").alias("text"))
    return comments.union(table(spark, sf_dir, "submissions").select(F.concat(F.lit("t3_"), "id").alias("name"), F.col("selftext").alias("text")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs. A text with more than COPIES names is a documented exception: its least name stands for it across links and is
    paired with each other name."""
    return copy_pairs(*near_copies(posts(spark, sf_dir), "name", "text", threshold=0.5, words=3, least_words=10), COPIES)


def p3_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the representatives of equal texts, and membership, for texts of any number of names."""
    return copy_pairs(*near_copies(posts(spark, sf_dir), "name", "text", threshold=0.5, words=3, least_words=10), 1)


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_groups(*near_copies(posts(spark, sf_dir), "name", "text", threshold=0.5, words=3, least_words=10))


def link_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = one_per_id(table(spark, sf_dir, "submissions"), subreddit=X.community("subreddit"), domain=X.domain("domain"))
    return rows.where(F.col("subreddit").isNotNull() & F.col("domain").isNotNull())


def _top(scored: DataFrame, score: str) -> DataFrame:
    best = W.partitionBy("record").orderBy(F.desc(score), "term")
    return scored.where(F.col("record_total") >= MIN_LINKS).withColumn("place", F.row_number().over(best)).where(F.col("place") <= TOP_DOMAINS)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = term_distinctiveness(link_submissions(spark, sf_dir), "subreddit", "domain")
    return _top(scored.withColumn("w", F.round("weight", 9)), "w").select(F.col("record").alias("subreddit"), F.col("term").alias("domain"))


def p5_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All domains of all communities with their log-likelihood ratio."""
    scored = term_distinctiveness(link_submissions(spark, sf_dir), "subreddit", "domain")
    return scored.select(F.col("record").alias("subreddit"), F.col("term").alias("domain"), "n", F.round("llr", 6).alias("llr"), F.round("weight", 9).alias("weight"))


def p5_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p5_found, by the log-likelihood ratio: the domains that mark a community most against all others."""
    scored = term_distinctiveness(link_submissions(spark, sf_dir), "subreddit", "domain").where("llr > 0")
    return _top(scored.withColumn("llr", F.round("llr", 6)), "llr").select(F.col("record").alias("subreddit"), F.col("term").alias("domain"), "llr", "place")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "suspicious_pairs").select(X.author("author_1").alias("a"), X.author("author_2").alias("b"))
    return group_matches(pairs, "a", "b").select(F.col("node").alias("author"), F.col("group").alias("group_author"))


_S = "'" + X.SPACES + "'"
SQL_LINKS = f"""links AS (SELECT * FROM (
  SELECT id, min(s) AS subreddit, min(d) AS domain FROM (
    SELECT id, {SQL_COMMUNITY} AS s, CASE WHEN x NOT LIKE 'self.%' THEN nullif(regexp_replace(x, '^www\\.', ''), '') END AS d
    FROM (SELECT *, lower(trim(domain, {_S})) AS x FROM submissions WHERE id IS NOT NULL)) GROUP BY id)
  WHERE subreddit IS NOT NULL AND domain IS NOT NULL),
cells AS (SELECT subreddit, domain, count(*)::DOUBLE AS n FROM links GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER (PARTITION BY subreddit) AS rt, sum(n) OVER (PARTITION BY domain) AS tt, sum(n) OVER () AS al,
  count(*) OVER (PARTITION BY domain) AS df, (SELECT count(DISTINCT subreddit) FROM cells) AS nr FROM cells),
w AS (SELECT *, round(n / rt * ln(nr / df::DOUBLE), 9) AS weight FROM t)"""


def _sql_part(k: str, row: str, column: str) -> str:
    return f"CASE WHEN {k} > 0 THEN {k} * ln({k} / (({row}) * ({column}) / al)) ELSE 0 END"


_G = "2 * (" + " + ".join([_sql_part("n", "tt", "rt"), _sql_part("(rt - n)", "al - tt", "rt"), _sql_part("(tt - n)", "tt", "al - rt"), _sql_part("(al - rt - tt + n)", "al - tt", "al - rt")]) + ")"
SQL_RATIO = f"round(CASE WHEN n < tt * rt / al THEN -1 ELSE 1 END * greatest({_G}, 0), 6)"
SQL_PAIR_ENDS = ", ".join(f"CASE WHEN trim(author_{i}, {_S}) NOT IN ('', '[deleted]', '[removed]', 'AutoModerator') THEN trim(author_{i}, {_S}) END AS {c}" for i, c in ((1, "a"), (2, "b")))

QUERIES = {"p2_found": p2_found, "p2_neighbours": p2_neighbours, "p3_found": p3_found, "p3_groups": p3_groups, "p3_representatives": p3_representatives, "p5_found": p5_found, "p5_ranked": p5_ranked, "p5_likelihood": p5_likelihood, "p7_found": p7_found} | corpus_queries.QUERIES
SQL_VECTORS = "v AS (SELECT vec_id, any_value(vec)::DOUBLE[] AS vec FROM comment_vectors WHERE list_sum(list_transform(vec, lambda x: abs(x))) > 0 GROUP BY vec_id)"
# cl: each text of ten words or more and the least name with the same words; lk: links between these representatives.
SQL_COPIES = """t AS (SELECT DISTINCT 't1_' || id AS name, body AS text FROM comments WHERE id IS NOT NULL AND body IS NOT NULL UNION ALL SELECT DISTINCT 't3_' || id, selftext FROM submissions WHERE id IS NOT NULL AND selftext IS NOT NULL),
w AS (SELECT name, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM t), cl AS (SELECT name, w, min(name) OVER (PARTITION BY w) AS class_name FROM w WHERE len(w) >= 10),
g AS (SELECT DISTINCT name, unnest([hash(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) for i in range(1, len(w) - 1)]) AS g FROM cl WHERE name = class_name),
n AS (SELECT name, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.name AS a, b.name AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.name < b.name GROUP BY 1, 2),
lk AS (SELECT a, b FROM c JOIN n x ON x.name = a JOIN n y ON y.name = b WHERE c >= 0.5 * (x.n + y.n - c))"""
SQL = corpus_queries.SQL | {
    "p2_found": f"""WITH {SQL_VECTORS},
s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.vec, b.vec) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.vec, b.vec) >= {ALIKE}),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM s)
SELECT DISTINCT least(a, b) AS vec_id_1, greatest(a, b) AS vec_id_2 FROM r WHERE k <= {NEIGHBOURS}""",
    "p2_neighbours": f"""WITH {SQL_VECTORS}, s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.vec, b.vec) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT a AS vec_id, b AS neighbour, round(c, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= {NEIGHBOURS}""",
    "p3_found": f"""WITH {SQL_COPIES}, sz AS (SELECT name, class_name, count(*) OVER (PARTITION BY class_name) AS n FROM cl), fa AS (SELECT * FROM sz WHERE n <= {COPIES} OR name = class_name),
pr AS (SELECT x.name AS a, y.name AS b FROM lk JOIN fa x ON x.class_name = lk.a JOIN fa y ON y.class_name = lk.b
  UNION ALL SELECT x.name, y.name FROM fa x JOIN fa y ON x.class_name = y.class_name AND x.name < y.name
  UNION ALL SELECT class_name, name FROM sz WHERE n > {COPIES} AND name <> class_name)
SELECT least(a, b) AS name_1, greatest(a, b) AS name_2 FROM pr""",
    "p3_representatives": f"""WITH {SQL_COPIES} SELECT a AS name_1, b AS name_2 FROM lk UNION ALL SELECT class_name, name FROM cl WHERE name <> class_name""",
    "p3_groups": f"""WITH RECURSIVE {SQL_COPIES},
sy AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk),
re(node, seen) AS (SELECT a, a FROM sy UNION SELECT sy.b, re.seen FROM re JOIN sy ON sy.a = re.node WHERE re.seen < sy.b),
gr AS (SELECT node, min(seen) AS group_name FROM re GROUP BY 1), dg AS (SELECT a AS node, count(*) AS n_links FROM sy GROUP BY 1)
SELECT name, class_name, coalesce(group_name, class_name) AS group_name, coalesce(n_links, 0) AS n_links FROM cl LEFT JOIN gr ON gr.node = class_name LEFT JOIN dg ON dg.node = class_name""",
    "p5_found": f"WITH {SQL_LINKS} SELECT subreddit, domain FROM w WHERE rt >= {MIN_LINKS} QUALIFY row_number() OVER (PARTITION BY subreddit ORDER BY weight DESC, domain) <= {TOP_DOMAINS}",
    "p5_likelihood": f"WITH {SQL_LINKS} SELECT subreddit, domain, n::BIGINT AS n, {SQL_RATIO} AS llr, weight FROM w",
    "p5_ranked": f"WITH {SQL_LINKS}, l AS (SELECT subreddit, domain, rt, {SQL_RATIO} AS llr FROM w) SELECT subreddit, domain, llr, row_number() OVER (PARTITION BY subreddit ORDER BY llr DESC, domain)::INT AS place FROM l WHERE rt >= {MIN_LINKS} AND llr > 0 QUALIFY place <= {TOP_DOMAINS}",
    "p7_found": f"""WITH RECURSIVE p AS (SELECT {SQL_PAIR_ENDS} FROM suspicious_pairs),
e AS (SELECT a, b FROM p WHERE a <> b UNION SELECT b, a FROM p WHERE a <> b),
r(author, seen) AS (SELECT a, a FROM e UNION SELECT e.b, r.seen FROM r JOIN e ON e.a = r.author WHERE r.seen < e.b)
SELECT author, min(seen) AS group_author FROM (SELECT * FROM r UNION SELECT a, b FROM e) GROUP BY author""",
}
