"""Queries that write the tables in a dump's formats, to the shared folder, and read them back through the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.plans.base import comments, sql_author, sql_records, submissions
from tallyloom.schema import COMMENT, POST
from tallyloom.session import cut, scratch, table
from tallyloom.sources import files, sinks

_BROKEN = ["", "   ", '{"id": "cut off', "no json", '{"name": "t1_named", "author": "planted_name", "score": 7}', '{"author": "planted_none", "score": 8}']


def _lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("raw"))


def jsonl_scan(spark: SparkSession, d: str) -> DataFrame:
    """All comments written as JSON lines, with blank, broken and nameless lines among them, and scanned: per author of rows that
    can be read the rows, ids and points. Ids are taken from the name, or made from the line, where there is none."""
    path = scratch(spark, "jsonl")
    sinks.write_lines(_lines(table(spark, d, "comments")).union(spark.createDataFrame([(x,) for x in _BROKEN], "raw string")), path)
    rows = files.read_jsonl(spark, path, POST, numbers=True)
    return rows.groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.when(~F.col("post_id").startswith("row_"), F.col("post_id"))).alias("n_ids"), F.sum("score").alias("score"))


def jsonl_malformed(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    sinks.write_lines(_lines(table(spark, d, "submissions")).union(spark.createDataFrame([(x,) for x in _BROKEN], "raw string")), path)
    return files.malformed_count(spark, path)


def jsonl_strict(spark: SparkSession, d: str) -> DataFrame:
    """Submissions as gzip JSON lines, scanned in the mode that ends at the first broken line."""
    path = scratch(spark, "strict")
    sinks.write_lines(_lines(table(spark, d, "submissions")), path, gzip=True)
    rows = files.read_jsonl(spark, path, POST, "FAILFAST")
    return rows.groupBy("is_self").agg(F.count(F.lit(1)).alias("n"), F.sum("num_comments").alias("n_comments"))


def nested_author_lines(spark: SparkSession, d: str) -> DataFrame:
    """Comments gathered to one JSON line per author, written with gzip and read flat again."""
    path = scratch(spark, "nested")
    rows = table(spark, d, "comments").withColumn("author", X.author("author")).where("author IS NOT NULL")
    raw = rows.select("author", F.to_json(F.struct(*[c for c in rows.columns if c != "author"])).alias("raw"))
    sinks.write_lines(sinks.nested_lines(raw, "comments"), path, "value", gzip=True)
    return files.nested(spark, path, "comments", COMMENT).groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))


def prefix_authors(spark: SparkSession, d: str) -> DataFrame:
    """Authors told from the first hundred characters of lines that begin with them."""
    path = scratch(spark, "prefix")
    rows = table(spark, d, "comments").where("author IS NOT NULL").select("author", "body", "id")
    sinks.write_lines(_lines(rows), path)
    return spark.read.text(path).select(X.author(files.prefix_author(F.col("value"))).alias("author")).where("author IS NOT NULL").groupBy("author").agg(F.count(F.lit(1)).alias("n"))


def post_view(spark: SparkSession, d: str) -> DataFrame:
    """The unified view of posts: type, number of words and text of comments and submissions with ten words or more."""
    c = comments(spark, d, "author", "body").select("id", "author", "body", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("selftext"))
    s = submissions(spark, d, "author", "title", "selftext").select("id", "author", F.lit(None).cast("string").alias("body"), "title", "selftext")
    return files.posts(c.union(s)).select("id", "post_type", X.word_count("text").alias("n_words"), F.md5("text").alias("text_hash"))


def csv_tables(spark: SparkSession, d: str) -> DataFrame:
    """Customers as CSV with a header and their columns in another order, read with the columns that must be there."""
    path = scratch(spark, "csv")
    sinks.write_table(table(spark, d, "customer"), path, ["c_name", "c_custkey", "c_nationkey", "c_acctbal"], "csv")
    rows = files.read_table(spark, path, ("c_custkey", "c_acctbal"))
    return rows.groupBy(F.col("c_nationkey").cast("long").alias("c_nationkey")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("c_acctbal").cast("double")), 2).alias("balance"))


def author_lists(spark: SparkSession, d: str) -> DataFrame:
    """Authors as a sorted list of lines, read as a set and placed."""
    path = scratch(spark, "list")
    sinks.write_sorted_list(table(spark, d, "comments").select(X.author("author").alias("author")), path)
    lines = files.numbered_lines(spark, [path]).select("line_no", F.col("value").alias("author"))
    return lines.join(files.read_list(spark, path), "author")


def list_heads(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred data lines of a CSV file in its order, and the numbers at the ends of its ragged lines."""
    path = scratch(spark, "head")
    lines = table(spark, d, "customer").select("c_custkey", F.concat_ws(",", "c_name", F.col("c_custkey").cast("string"), F.lit(""), F.lit("")).alias("value"))
    header = spark.createDataFrame([(-1, "name,number")], "c_custkey long, value string")
    header.unionByName(lines).orderBy("c_custkey").coalesce(1).select("value").write.text(path)  # one file, as such lists are
    head = files.head_in_order(spark, path, 100).select("line_no")
    return files.tail_numbers(spark, path).join(head, "line_no").select((F.col("line_no") - 1).cast("long").alias("place"), "value")


def partitioned_lines(spark: SparkSession, d: str) -> DataFrame:
    """Both kinds in one folder per kind and community, read by folder."""
    path = scratch(spark, "by")
    both = comments(spark, d, "subreddit").withColumn("kind", F.lit("comments")).union(submissions(spark, d, "subreddit").withColumn("kind", F.lit("submissions"))).where("subreddit IS NOT NULL")
    sinks.write_by(both.select("id", "subreddit", "kind"), path, ["kind", "subreddit"])
    rows = spark.read.schema("id string, kind string, subreddit string").json(path)
    return rows.groupBy("kind", "subreddit").agg(F.count(F.lit(1)).alias("n"))


def appended_once(spark: SparkSession, d: str) -> DataFrame:
    """Comments appended to a table in two runs of which the second repeats the first: each id stands once."""
    path = scratch(spark, "append")
    rows = comments(spark, d, "subreddit")
    first = sinks.append_new(rows.where("id < 'm'"), path, "id")
    second = sinks.append_new(rows, path, "id")
    third = sinks.append_new(rows, path, "id")
    found = spark.read.parquet(path)
    return found.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids")).select("n", "n_ids", (F.lit(first + second) == F.col("n")).alias("all_appended"), F.lit(third).cast("long").alias("appended_again"))


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """The counters of a run, as the summary file holds them."""
    path = scratch(spark, "summary") + ".json"
    rows = comments(spark, d, "author", "subreddit")
    sinks.write_summary(rows, path, n=F.count(F.lit(1)), authors=F.countDistinct("author"), communities=F.countDistinct("subreddit"))
    return spark.read.schema("n long, authors long, communities long").option("multiLine", True).json(path)


def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    """The data of a histogram over scores."""
    return sinks.histogram(cut(table(spark, d, "comments").where("score IS NOT NULL").select(F.col("score").cast("double").alias("score"))), "score", 20)


def file_periods(spark: SparkSession, d: str) -> DataFrame:
    """What the names of a dump's files say: kind, community, and whether the year is wanted."""
    names = ["x/RC_2021-03.zst", "x/RS_2022-11.zst", "y/comments_2019.jsonl", "y/submission-2023_05.jsonl.gz", "z/other.txt", "q/sealtalk_comments.zst"]
    kept = set(files.within_years(names, 2020, 2022))
    rows = spark.createDataFrame([(n, *files.period_of(n), n in kept) for n in names], "file string, year int, month int, wanted boolean")
    return rows.withColumn("kind", files.kind_of(F.col("file"))).withColumn("community", files.community_of_file(F.col("file")))


_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
QUERIES = {f.__name__: f for f in (jsonl_scan, jsonl_malformed, jsonl_strict, nested_author_lines, prefix_authors, post_view, csv_tables, author_lists, list_heads, partitioned_lines, appended_once, run_summary, score_histogram, file_periods)}
SQL = {
    "jsonl_scan": "SELECT author, count(*) AS n, count(DISTINCT k) AS n_ids, CAST(sum(score) AS BIGINT) AS score FROM (SELECT author, coalesce(nullif(id, ''), nullif(name, '')) AS k, score FROM comments UNION ALL VALUES ('planted_name', 't1_named', 7), ('planted_none', NULL, 8)) GROUP BY 1",
    "jsonl_malformed": f"SELECT count(*) + {len(_BROKEN)} AS lines, 2::BIGINT AS blank, 2::BIGINT AS malformed FROM submissions",
    "jsonl_strict": "SELECT is_self, count(*) AS n, CAST(sum(num_comments) AS BIGINT) AS n_comments FROM submissions GROUP BY 1",
    "nested_author_lines": f"SELECT author, count(*) AS n, CAST(sum(score) AS BIGINT) AS score FROM (SELECT {sql_author()} AS author, score FROM comments) WHERE author IS NOT NULL GROUP BY 1",
    "prefix_authors": f"SELECT author, count(*) AS n FROM (SELECT {sql_author()} AS author FROM comments WHERE author IS NOT NULL AND length(author) <= 80) WHERE author IS NOT NULL GROUP BY 1",
    "post_view": f"""WITH {sql_records('comments', 'c0', 'author', 'body')}, {sql_records('submissions', 's0', 'author', 'title', 'selftext')},
a AS (SELECT id, author, CASE WHEN trim(body) <> '' THEN 'comment' ELSE 'submission' END AS post_type, CASE WHEN trim(body) <> '' THEN body ELSE '' END AS t FROM c0 UNION ALL
  SELECT id, author, 'submission', concat_ws(' ', CASE WHEN trim(title) <> '' THEN title END, CASE WHEN trim(selftext) <> '' THEN selftext END) FROM s0),
b AS (SELECT id, author, post_type, trim(regexp_replace(t, '{_SPACE}', ' ', 'g')) AS t FROM a)
SELECT id, post_type, len(string_split(t, ' '))::INT AS n_words, md5(t) AS text_hash FROM b WHERE author IS NOT NULL AND t NOT IN ('', '[deleted]', '[removed]') AND len(string_split(t, ' ')) >= 10""",
    "csv_tables": "SELECT c_nationkey::BIGINT AS c_nationkey, count(*) AS n, round(sum(c_acctbal::DOUBLE), 2) AS balance FROM customer GROUP BY 1",
    "author_lists": f"SELECT author, row_number() OVER (ORDER BY author) AS line_no FROM (SELECT DISTINCT {sql_author()} AS author FROM comments) WHERE author IS NOT NULL",
    "list_heads": "SELECT row_number() OVER (ORDER BY c_custkey) AS place, c_custkey::BIGINT AS value FROM customer QUALIFY place <= 100",
    "partitioned_lines": f"WITH {sql_records('comments', 'c0', 'subreddit')}, {sql_records('submissions', 's0', 'subreddit')} SELECT kind, subreddit, count(*) AS n FROM (SELECT 'comments' AS kind, subreddit FROM c0 UNION ALL SELECT 'submissions', subreddit FROM s0) WHERE subreddit IS NOT NULL GROUP BY 1, 2",
    "appended_once": "SELECT count(DISTINCT id) AS n, count(DISTINCT id) AS n_ids, true AS all_appended, 0::BIGINT AS appended_again FROM comments WHERE id IS NOT NULL",
    "run_summary": f"WITH {sql_records('comments', 'c0', 'author', 'subreddit')} SELECT count(*) AS n, count(DISTINCT author) AS authors, count(DISTINCT subreddit) AS communities FROM c0",
    "score_histogram": """WITH s AS (SELECT score::DOUBLE AS x FROM comments WHERE score IS NOT NULL), r AS (SELECT min(x) AS lo, (max(x) - min(x)) / 20 AS w FROM s),
b AS (SELECT least(floor((x - lo) / w), 19)::INT AS bin, count(*) AS n FROM s, r GROUP BY 1) SELECT bin, lo + bin * w AS low, lo + (bin + 1) * w AS high, n FROM b, r""",
    "file_periods": "SELECT * FROM (VALUES ('x/RC_2021-03.zst', 2021, 3, true, 'comments', 'RC'), ('x/RS_2022-11.zst', 2022, 11, true, 'submissions', 'RS'), ('y/comments_2019.jsonl', 2019, NULL, false, 'comments', 'comments'), ('y/submission-2023_05.jsonl.gz', 2023, 5, false, 'submissions', 'submission-2023'), ('z/other.txt', NULL, NULL, false, 'unknown', 'other'), ('q/sealtalk_comments.zst', NULL, NULL, false, 'comments', 'sealtalk')) AS v(file, year, month, wanted, kind, community)",
}
