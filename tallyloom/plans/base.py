"""The project's tables in their normal form, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators.records import one_per_id
from tallyloom.session import table

_FORMS = {"author": lambda: X.author("author"), "subreddit": lambda: X.community("subreddit"), "created_utc": lambda: F.when(F.col("created_utc") > 0, F.col("created_utc")), "domain": lambda: X.domain("domain")}


def records(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One row per id of comments or submissions, with the columns asked for in normal form: of copies that of the earliest
    period and least score, so that the choice doesn't depend on the columns."""
    kept = {c: _FORMS[c]() if c in _FORMS else F.col(c) for c in columns}
    return one_per_id(table(spark, sf_dir, name), _period=F.col("source_period"), _score=F.col("score"), **kept).drop("_period", "_score")


def comments(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return records(spark, sf_dir, "comments", *columns)


def submissions(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return records(spark, sf_dir, "submissions", *columns)


S = "'" + X.SPACES + "'"
NONE = ", ".join(f"'{x}'" for x in X.NO_AUTHOR)


def sql_author(c: str = "author") -> str:
    return f"CASE WHEN trim({c}, {S}) NOT IN ('', {NONE}) THEN trim({c}, {S}) END"


_SQL = {
    "author": sql_author(),
    "subreddit": f"nullif(trim(regexp_replace(lower(trim(subreddit, {S})), '^/?r/', ''), {S}), '')",
    "created_utc": "CASE WHEN created_utc > 0 THEN created_utc END",
    "domain": f"CASE WHEN lower(trim(domain, {S})) NOT LIKE 'self.%' THEN nullif(regexp_replace(lower(trim(domain, {S})), '^www\\.', ''), '') END",
}


def sql_records(name: str, view: str, *columns: str) -> str:
    """A WITH item of the same rows: of copies of a record the first by period, score and columns, nulls last."""
    exprs = ", ".join(f"{_SQL.get(c, c)} AS {c}_" for c in columns)
    order = ", ".join(["source_period NULLS LAST", "score NULLS LAST", *(f"{c}_ NULLS LAST" for c in columns)])
    return f"{view} AS (SELECT id, {', '.join(f'{c}_ AS {c}' for c in columns)} FROM (SELECT id, source_period, score, {exprs} FROM {name} WHERE id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY {order}) = 1)"


def planted(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows that no generated table has, for rules that fire rarely."""
    return spark.createDataFrame(rows, schema)


def sql_planted(rows: list[tuple], schema: str) -> str:
    """The same rows as a SQL relation."""
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    columns = [c.split() for c in schema.split(", ")]
    values = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
    picked = ", ".join(f"CAST({n} AS {'VARCHAR' if t == 'string' else t}) AS {n}" for n, t in columns)
    return f"(SELECT {picked} FROM (VALUES {values}) AS v({', '.join(n for n, _ in columns)}))"
