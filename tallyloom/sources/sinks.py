"""Sinks: JSON lines, tables, nested and partitioned files, summaries and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.text import preview
from tallyloom.sources.paths import matching, write_text


def write_lines(rows: DataFrame, path: str, column: str = "raw", gzip: bool = False, mode: str = "overwrite") -> None:
    """Raw lines as they came in."""
    rows.select(F.col(column).alias("value")).where("value IS NOT NULL").write.mode(mode).option("compression", "gzip" if gzip else "none").text(path)


def write_table(rows: DataFrame, path: str, columns: list[str] | None = None, kind: str = "parquet", mode: str = "overwrite") -> None:
    """Parquet or CSV with the columns in the order given."""
    out = rows.select(*(columns or rows.columns))
    out.write.mode(mode).option("header", True).option("escape", '"').format(kind).save(path)


def write_by(rows: DataFrame, path: str, keys: list[str], mode: str = "overwrite") -> None:
    """JSON lines in one folder per combination of keys. Rows aren't gathered by key: a large key may have several files."""
    rows.write.mode(mode).partitionBy(*keys).json(path)


def nested_lines(rows: DataFrame, field: str, payload: str = "raw", order: str | None = None, most: int = 100_000) -> DataFrame:
    """(author, part, value): a JSON line {"author": ..., field: [...]} with the payloads as they are, unparsed. An author with
    more than `most` records gets several lines, as one row must hold a whole line."""
    place = F.xxhash64(payload) if order is None else F.col(order)
    parts = rows.groupBy("author").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))
    spread = rows.join(parts, "author").withColumn("part", F.pmod(F.xxhash64(payload), F.col("parts")))
    by = spread.groupBy("author", "part").agg(F.array_sort(F.collect_list(F.struct(place.alias("o"), F.col(payload).alias("p")))).alias("x"))
    line = F.concat(F.lit('{"author":'), F.regexp_extract(F.to_json(F.struct(F.col("author").alias("a"))), r'^\{"a":(.*)\}$', 1), F.lit(f',"{field}":['), F.array_join(F.transform("x", lambda s: s["p"]), ","), F.lit("]}"))
    return by.select("author", "part", line.alias("value"))


def write_sorted_list(rows: DataFrame, path: str, column: str = "author", mode: str = "overwrite") -> None:
    """Different values in order, one per line, in one file: for lists that people read."""
    rows.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct().orderBy("value").coalesce(1).write.mode(mode).text(path)


def write_summary(rows: DataFrame, path: str, **counters) -> dict:
    """One aggregate over the rows, as a JSON file; counters are aggregate columns by name."""
    found = rows.agg(*[c.alias(n) for n, c in counters.items()]).first().asDict()
    write_text(rows.sparkSession, path, json.dumps(found, ensure_ascii=False, indent=1, sort_keys=True, default=str))
    return found


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key isn't in the table yet and returns their number; run again after a failure it goes on where it
    stopped."""
    spark = rows.sparkSession
    fresh = rows
    if matching(spark, f"{path}/*.parquet"):
        fresh = rows.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    fresh = fresh.persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def report(pairs: DataFrame, posts: DataFrame, users: int = 20, examples: int = 5, width: int = 200) -> str:
    """Markdown on the users with most pairs: their partners and some of their texts. pairs: (user_1, user_2, similarity, shared);
    posts: (author, created_utc, text). Only `users` users and `examples` texts of each come to the driver."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("user_1").alias("u"), F.col("user_2").alias("v")), F.struct(F.col("user_2").alias("u"), F.col("user_1").alias("v")))).alias("x"), "similarity", "shared").select("x.u", "x.v", "similarity", "shared")
    top = ends.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.max("similarity").alias("s")).orderBy(F.desc("n"), F.desc("s"), "u").limit(users)
    best = ends.join(top.select("u"), "u", "left_semi").withColumn("k", F.row_number().over(W.partitionBy("u").orderBy(F.desc("similarity"), "v"))).where(F.col("k") <= examples).collect()
    texts = posts.join(top.select(F.col("u").alias("author")), "author", "left_semi").withColumn("k", F.row_number().over(W.partitionBy("author").orderBy(F.desc("created_utc"), "text"))).where(F.col("k") <= examples).select("author", "k", preview("text", width).alias("text")).collect()
    out = []
    for r in top.collect():
        out.append(f"## {r['u']}\n\n{r['n']} pairs, highest similarity {r['s']:.4f}\n")
        out += [f"- {b['v']}: {b['similarity']:.4f}, {b['shared']} shared" for b in sorted(best, key=lambda b: b["k"]) if b["u"] == r["u"]]
        out.append("")
        out += [f"> {t['text']}" for t in sorted(texts, key=lambda t: t["k"]) if t["author"] == r["u"]]
        out.append("")
    return "\n".join(out)


def histogram(rows: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, low, high, n): the data of a histogram over the column's range."""
    lo, hi = rows.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return rows.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    width = (float(hi) - float(lo)) / bins or 1.0
    b = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)).cast("int")
    n = rows.where(F.col(column).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("bin", (F.lit(float(lo)) + F.col("bin") * width).alias("low"), (F.lit(float(lo)) + (F.col("bin") + 1) * width).alias("high"), "n")

