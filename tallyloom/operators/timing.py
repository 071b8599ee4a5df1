"""Fast replies: siblings, adjacent responses, and direct replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bare_id(c: Column | str) -> Column:
    """An id without its kind's prefix t1_, t2_ or t3_."""
    return F.regexp_replace(c if isinstance(c, Column) else F.col(c), "^t[123]_", "")


def parent_type(c: str, strict: bool = False) -> Column:
    """"comment" for t1_; "post" for t3_, or for anything else unless strict, when other prefixes give null."""
    other = F.when(F.col(c).startswith("t3_"), "post") if strict else F.when(F.col(c).isNotNull(), "post")
    return F.when(F.col(c).startswith("t1_"), "comment").otherwise(other)


def whole_seconds(later: Column, earlier: Column) -> Column:
    """The difference in whole seconds, truncated towards zero."""
    return (later - earlier).cast("int")


def sibling_replies(comments: DataFrame, seconds: int) -> DataFrame:
    """Pairs of replies by different authors to one parent at most `seconds` whole seconds apart, in time order (ties by id).

    comments: id, author, parent, subreddit, created_utc. The pairs of a parent are met by time bins of seconds + 1: each
    reply meets its own bin and the next, so that a parent with a third of all replies is as many keys as it has bins and
    no reply meets one that can't be near it.
    """
    width = float(seconds + 1)
    rows = comments.where("id IS NOT NULL AND author IS NOT NULL AND parent IS NOT NULL AND created_utc IS NOT NULL").select("id", "author", "parent", "subreddit", "created_utc", F.floor(F.col("created_utc") / width).alias("bin"))
    first = rows.select("parent", "bin", *[F.col(c).alias(f"{c}_a") for c in ("id", "author", "created_utc")], "subreddit")
    second = rows.select("parent", F.explode(F.array(F.col("bin"), F.col("bin") - 1)).alias("bin"), *[F.col(c).alias(f"{c}_b") for c in ("id", "author", "created_utc")])
    ordered = (F.col("created_utc_a") < F.col("created_utc_b")) | ((F.col("created_utc_a") == F.col("created_utc_b")) & (F.col("id_a") < F.col("id_b")))
    delta = whole_seconds(F.col("created_utc_b"), F.col("created_utc_a"))
    near = first.join(second, ["parent", "bin"]).where(ordered & (F.col("author_a") != F.col("author_b")) & (delta <= seconds))
    return near.select("parent", "author_a", "author_b", "id_a", "id_b", "created_utc_a", "created_utc_b", "subreddit", delta.alias("delta_seconds"))


def firsts(rows: DataFrame, keys: list[str], value: str, order: str, n: int, name: str) -> DataFrame:
    """(*keys, name): for each key the first n different values by their least place in order, joined. At most n values of a
    key reach one row, whatever the size of the group."""
    least = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("o"))
    top = least.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy("o", value))).where(F.col("k") <= n)
    return top.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", value))), lambda s: s[value]), ", ").alias(name))


def pair_rollup(events: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Per key: instances, normalized_frequency (by the largest group, taken before small groups are dropped), max, mean and min
    of delta_seconds; groups of at least `least`."""
    by = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("instances"), F.max("delta_seconds").alias("max_delta"), F.round(F.avg("delta_seconds"), 2).alias("avg_delta"), F.min("delta_seconds").alias("min_delta"))
    most = by.agg(F.max("instances").alias("most"))
    return by.crossJoin(F.broadcast(most)).withColumn("normalized_frequency", F.round(F.col("instances") / F.col("most"), 3)).where(F.col("instances") >= least).drop("most")  # one row


def adjacent_responses(comments: DataFrame, thread: str, seconds: int, slot: float = 86400.0) -> DataFrame:
    """Consecutive comments of a thread (by time, then id) by different authors, 0 to `seconds` whole seconds apart.

    A thread is cut into slots of time, and the last comments of a slot, those within seconds of its end, are seen in the
    next slot too, so that the comment before is at hand whenever it is near enough; a thread with a third of all comments
    is as many groups as it has slots."""
    width = max(float(slot), 2.0 * (seconds + 1))
    rows = comments.where(F.col(thread).isNotNull() & F.col("author").isNotNull() & F.col("created_utc").isNotNull())
    at = F.floor(F.col("created_utc") / width)
    rows = rows.select(F.col(thread).alias("thread_id"), "subreddit", "author", "created_utc", "id", at.alias("own"))
    late = (F.col("own") + 1) * width - F.col("created_utc") <= seconds + 1
    rows = rows.withColumn("slot", F.explode(F.when(late, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))))
    w = W.partitionBy("thread_id", "slot").orderBy("created_utc", "id")
    rows = rows.withColumn("p", F.lag(F.struct("author", "created_utc", "id")).over(w)).where("slot = own")
    near = rows.where(F.col("p").isNotNull() & (F.col("author") != F.col("p.author"))).withColumn("delta_seconds", whole_seconds(F.col("created_utc"), F.col("p.created_utc")))
    return near.where(F.col("delta_seconds").between(0, seconds)).select("thread_id", "subreddit", F.col("author").alias("responder_author"), F.col("p.author").alias("previous_author"), F.col("id").alias("responder_comment_id"), F.col("p.id").alias("previous_comment_id"), "delta_seconds")


def responder_accounts(events: DataFrame, least_events: int, least_threads: int) -> DataFrame:
    by = events.groupBy("responder_author").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("thread_id").alias("threads"), F.countDistinct("previous_author").alias("partners"), F.round(F.avg("delta_seconds"), 2).alias("avg_delta"), F.min("delta_seconds").alias("min_delta"))
    return by.where((F.col("events") >= least_events) & (F.col("threads") >= least_threads))


def direct_replies(comments: DataFrame, seconds: int) -> DataFrame:
    """Comments that answer another author's comment within 0 to `seconds` whole seconds of it. comments: id, author, parent (a
    comment's id), thread, subreddit, created_utc; ids are unique."""
    parents = comments.select(F.col("id").alias("parent"), F.col("author").alias("parent_author"), F.col("created_utc").alias("parent_utc"))
    both = comments.join(parents, "parent").withColumn("delta_seconds", whole_seconds(F.col("created_utc"), F.col("parent_utc")))
    both = both.where((F.col("author") != F.col("parent_author")) & F.col("delta_seconds").between(0, seconds))
    return both.select(F.col("author").alias("child_author"), "parent_author", F.col("parent").alias("parent_comment_id"), F.col("id").alias("child_comment_id"), F.col("thread").alias("root_post_id"), "subreddit", "delta_seconds")
