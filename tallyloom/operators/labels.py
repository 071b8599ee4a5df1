"""Labels of accounts from name rules, rank lists and phrases, and their diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import rules as R


def record_matches(posts: DataFrame, ranked: DataFrame) -> DataFrame:
    """posts (author, text) with by_name, by_rank and by_phrase: which rule each record meets. ranked: (author), lower-cased names
    of a rank list, joined on the lower-cased author."""
    known = ranked.select(F.lower("author").alias("low")).distinct().withColumn("by_rank", F.lit(True))
    rows = posts.withColumn("low", F.lower("author")).join(known, "low", "left").drop("low")
    return rows.withColumn("by_name", R.name_pattern("author").isNotNull()).withColumn("by_rank", F.coalesce("by_rank", F.lit(False))).withColumn("by_phrase", R.has_phrase("text"))


def matching_authors(matched: DataFrame, least: int = 3, humans: bool = False) -> DataFrame:
    """(author, n_posts): authors by the number of records that meet a rule, or for humans of those that meet none; an author
    may be in both lists."""
    hit = F.col("by_name") | F.col("by_rank") | F.col("by_phrase")
    return matched.where(~hit if humans else hit).groupBy("author").agg(F.count(F.lit(1)).alias("n_posts")).where(F.col("n_posts") >= least)


def author_statistics(posts: DataFrame) -> DataFrame:
    """One row per author of posts (author, kind, created_utc, author_fullname): numbers, first and last time, span in days, and
    the fullname of the first record, comments before submissions, then by time and name."""
    order = F.struct((F.col("kind") != "comment").cast("int").alias("k"), "created_utc", "author_fullname")
    name = F.when((F.col("author_fullname") != "") & F.col("author_fullname").isNotNull(), F.struct(order.alias("o"), F.col("author_fullname").alias("v")))
    by = posts.groupBy("author").agg(F.count_if(F.col("kind") == "comment").alias("num_comments"), F.count_if(F.col("kind") != "comment").alias("num_submissions"), F.min("created_utc").alias("first_seen_utc"), F.max("created_utc").alias("last_seen_utc"), F.min(name)["v"].alias("author_fullname"))
    return by.withColumn("total_posts", F.col("num_comments") + F.col("num_submissions")).withColumn("account_span_days", F.coalesce((F.col("last_seen_utc") - F.col("first_seen_utc")) / 86400.0, F.lit(0.0)))


def assign_labels(stats: DataFrame, ranked: DataFrame, least_posts: int = 3, sure: float = 0.8) -> DataFrame:
    """stats with label, label_source, label_confidence, y and botrank_score. A rank score of at least `sure` overrides the name
    rules. ranked: (author, score); of repeated names (in any case) the greatest score counts."""
    scores = ranked.groupBy(F.lower("author").alias("low")).agg(F.max("score").alias("botrank_score"))
    rows = stats.where(F.col("total_posts") >= least_posts).withColumn("low", F.lower("author")).join(scores, "low", "left").drop("low")
    rule = R.name_label("author", R.NOT_BOTS)
    over = F.coalesce(F.col("botrank_score") >= sure, F.lit(False))
    rows = rows.withColumn("rule", rule)
    rows = rows.withColumn("label", F.when(over, "bot").otherwise(F.col("rule.label"))).withColumn("label_source", F.when(over, "botrank").otherwise("rule")).withColumn("label_confidence", F.when(over, F.col("botrank_score")).otherwise(1.0))
    return rows.withColumn("y", (F.col("label") == "bot").cast("int")).drop("rule")


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """(low, high) of the 95% interval of a rate; null for no trials."""
    p, m = hits / n, n.cast("double")
    mid, half = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    return F.when(n > 0, F.struct(((mid - half) / (1 + z * z / m)).alias("low"), ((mid + half) / (1 + z * z / m)).alias("high")))


def diagnose(posts: DataFrame, ranked: DataFrame) -> DataFrame:
    """(author, rule, matches): for each author of posts (author, text) the first rule of name (A), rank list (B) and phrases (C)
    that it meets, or none, and the number of its texts with a phrase where C decides."""
    per = posts.groupBy("author").agg(F.count_if(R.has_phrase("text", R.DIAGNOSIS_PHRASES)).alias("phrases"))
    known = ranked.select(F.lower("author").alias("low")).distinct().withColumn("ranked", F.lit(True))
    rows = per.withColumn("low", F.lower("author")).join(known, "low", "left")
    rule = F.when(R.name_pattern("author", R.NOT_BOTS).isNotNull(), "A").when(F.col("ranked"), "B").when(F.col("phrases") > 0, "C").otherwise("none")
    return rows.select("author", rule.alias("rule"), F.when(rule == "C", F.col("phrases")).otherwise(0).alias("matches"))


def diagnosis_summary(diagnosed: DataFrame) -> DataFrame:
    """(rule, n, rate, low, high): how many authors each rule decides, with the interval of the rate."""
    n = diagnosed.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    rows = n.crossJoin(F.broadcast(diagnosed.agg(F.count(F.lit(1)).alias("all"))))  # one row
    w = wilson(F.col("n"), F.col("all"))
    return rows.select("rule", "n", F.round(F.col("n") / F.col("all"), 5).alias("rate"), F.round(w["low"], 5).alias("low"), F.round(w["high"], 5).alias("high"))


def compare_lists(before: DataFrame, after: DataFrame, key: str = "author") -> DataFrame:
    """(key, change): kept, added or eliminated."""
    both = before.select(key).distinct().withColumn("b", F.lit(True)).join(after.select(key).distinct().withColumn("a", F.lit(True)), key, "full")
    return both.select(key, F.when(F.col("b") & F.col("a"), "kept").when(F.col("a"), "added").otherwise("eliminated").alias("change"))
