"""Per-author features, in groups that may be built and joined separately.

comments: author, created_utc, score, subreddit, body, controversiality, banned_at_utc, parent (a comment's bare id or null);
submissions: author, created_utc, score, subreddit, title, selftext, url, upvote_ratio, num_comments, removed_by_category,
over_18, banned_at_utc. A missing value is null, never NaN. Each group is one pass with partial aggregates; entropies, which
need an author's whole sample, gather at most GATHERED numbers and rank more by ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions import stylometrics as Y
from tallyloom.functions import urls as U
from tallyloom.functions.text import NO_TEXT
from tallyloom.operators.records import numbered
from tallyloom.session import cut

DAY = 86400.0
GATHERED = 100_000  # so many values of one author, less than a megabyte, may come into one row


def _both(comments: DataFrame, submissions: DataFrame, *columns: str) -> DataFrame:
    pick = lambda df, kind: df.select("author", F.lit(kind).alias("kind"), *[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns])
    return pick(comments, "comment").unionByName(pick(submissions, "submission")).where("author IS NOT NULL")


def activity(comments: DataFrame, submissions: DataFrame) -> DataFrame:
    """Counts, rates per day of the account's span (at least one day) and the span in days; times that are null or 0 don't
    count for the span."""
    rows = _both(comments, submissions, "created_utc")
    time = F.when(F.col("created_utc") != 0, F.col("created_utc"))
    is_comment = F.col("kind") == "comment"
    by = rows.groupBy("author").agg(F.count_if(is_comment).alias("num_comments"), F.count_if(~is_comment).alias("num_submissions"), ((F.max(time) - F.min(time)) / DAY).alias("span"))
    days = F.coalesce("span", F.lit(0.0))
    return by.select("author", "num_comments", "num_submissions", (F.col("num_comments") + F.col("num_submissions")).alias("total_posts"), (F.col("num_comments") / F.greatest(days, F.lit(1.0))).alias("comments_per_day"), (F.col("num_submissions") / F.greatest(days, F.lit(1.0))).alias("submissions_per_day"), days.alias("account_age_days"))


def gaps(rows: DataFrame, keys: tuple[str, ...] = ("author",), slot: float = DAY) -> DataFrame:
    """(*keys, gap): seconds between a key's consecutive posts. Posts are met within slots of time, and the first and last of each
    slot across slots, so that a key with a third of all posts is as many groups as it has slots."""
    timed = rows.where("created_utc IS NOT NULL AND created_utc <> 0").select(*keys, F.floor(F.col("created_utc") / slot).alias("slot"), "created_utc").repartition(*keys, "slot")
    inside = timed.select(*keys, (F.col("created_utc") - F.lag("created_utc").over(W.partitionBy(*keys, "slot").orderBy("created_utc"))).alias("gap"))
    ends = timed.groupBy(*keys, "slot").agg(F.min("created_utc").alias("a"), F.max("created_utc").alias("b"))
    across = ends.select(*keys, (F.col("a") - F.lag("b").over(W.partitionBy(*keys).orderBy("slot"))).alias("gap"))
    return inside.union(across).where("gap IS NOT NULL")


def sample_statistics(values: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """(*keys, mean, least, deviation, variance, entropy) of each key's values: population deviation, sample variance and differential
    entropy, all null where a key has only nulls (entropy for fewer than five values, too).

    No key's values come into one row but those of keys with at most GATHERED of them. The entropy of a larger one needs the
    values m ranks apart, m being floor(sqrt(n) + 0.5): its different values are ranked by ranges and met by rank. A value
    that fills a whole window makes it -infinity, and then nothing is ranked."""
    values = cut(values.select(*keys, F.col(value).alias("v")))
    by = values.groupBy(*keys).agg(F.avg("v").alias("mean"), F.min("v").alias("least"), F.stddev_pop("v").alias("deviation"), F.var_samp("v").alias("variance"), F.count("v").alias("n"))
    by = cut(by)
    large = by.where(F.col("n") > GATHERED).select(*keys, "n", F.floor(F.sqrt(F.col("n").cast("double")) + 0.5).cast("long").alias("m"))
    given = values.where("v IS NOT NULL")
    some = given.join(large, list(keys), "left_anti") if not large.isEmpty() else given
    entropy = some.groupBy(*keys).agg(F.sort_array(F.collect_list("v")).alias("x")).select(*keys, Y.differential_entropy(F.col("x")).alias("entropy"))
    if some is not given:
        levels = cut(given.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c")).join(large, list(keys)))
        tied = levels.where(F.col("c") > 2 * F.col("m")).select(*keys).distinct()
        loose = levels.join(tied, list(keys), "left_anti")
        ranked = numbered(loose, [F.col("v")], "c", keys)
        each = cut(ranked.select(*keys, "n", "m", "v", F.explode(F.sequence(F.col("upto") - F.col("c") + 1, F.col("upto"))).alias("i")))
        up = each.select(*keys, (F.col("i") - F.col("m")).alias("i"), F.col("v").alias("above"))
        down = each.select(*keys, (F.col("i") + F.col("m")).alias("i"), F.col("v").alias("below"))
        ends = loose.groupBy(*keys).agg(F.max("v").alias("top"), F.min("v").alias("bottom"))
        met = each.join(up, [*keys, "i"], "left").join(down, [*keys, "i"], "left").join(ends, list(keys))
        wide = F.coalesce("above", "top") - F.coalesce("below", "bottom")
        term = F.when(wide > 0, F.ln(F.col("n") / (2.0 * F.col("m")) * wide)).otherwise(F.lit(float("-inf")))
        entropy = entropy.union(met.groupBy(*keys).agg((F.sum(term) / F.max("n")).alias("entropy"))).union(tied.select(*keys, F.lit(float("-inf")).alias("entropy")))
    return by.join(entropy, list(keys), "left").drop("n")


def _named(prefix: str, what: str) -> list[Column]:
    names = {"mean": f"mean_{what}_seconds", "least": f"min_{what}_seconds", "deviation": f"std_{what}_seconds", "variance": f"{what}_variance", "entropy": f"{what}_entropy"}
    return [F.col(c).alias(prefix + n) for c, n in names.items()]


def intervals(comments: DataFrame, submissions: DataFrame) -> DataFrame:
    """For comments, submissions and both together: mean, least and population deviation of the gaps, their sample variance and
    their differential entropy. The three series are one pass."""
    one = comments.select("author", "created_utc", F.array(F.lit("comment"), F.lit("all_posts")).alias("s")).union(submissions.select("author", "created_utc", F.array(F.lit("submission"), F.lit("all_posts"))))
    series = one.select("author", F.explode("s").alias("series"), "created_utc").where("author IS NOT NULL")
    found = cut(sample_statistics(gaps(series, ("author", "series")), ("author", "series"), "gap"))
    groups = [found.where(F.col("series") == s).select("author", *_named(f"{s}_", "interval")) for s in ("comment", "submission", "all_posts")]
    return join_features(groups, "full")


def reply_times(comments: DataFrame, parents: DataFrame, mode: str = "per_parent_last") -> DataFrame:
    """Times from a comment to its parent comment: mean, least, population standard deviation, sample variance, differential
    entropy, and coverage, the part of replies whose parent is known. parents: (id, created_utc), one row per id.
    mode "per_reply" counts each reply, "per_parent_last" of several replies to one parent the last in time. Negative times
    don't count."""
    replies = comments.where("author IS NOT NULL AND parent IS NOT NULL AND created_utc IS NOT NULL AND created_utc <> 0").select("author", "parent", "created_utc")
    if mode == "per_parent_last":
        replies = replies.groupBy("author", "parent").agg(F.max("created_utc").alias("created_utc"))
    both = replies.join(parents.select(F.col("id").alias("parent"), F.col("created_utc").alias("then")), "parent", "left")
    t = F.when(F.col("created_utc") >= F.col("then"), F.col("created_utc") - F.col("then"))
    both = cut(both.select("author", t.alias("t")))
    coverage = both.groupBy("author").agg((F.count("t") / F.count(F.lit(1))).alias("reply_time_coverage"))
    found = sample_statistics(both, ("author",), "t")
    return found.select("author", *_named("", "reply_time")).join(coverage, "author")


def engagement(comments: DataFrame, submissions: DataFrame) -> DataFrame:
    rows = _both(comments, submissions, "score", "upvote_ratio", "num_comments")
    is_comment = F.col("kind") == "comment"
    by = rows.groupBy("author").agg(F.avg(F.when(is_comment, F.col("score"))).alias("mean_comment_score"), F.avg(F.when(~is_comment, F.col("score"))).alias("mean_submission_score"), F.avg("upvote_ratio").alias("mean_upvote_ratio"), F.avg("num_comments").alias("mean_comments_received_per_submission"))
    return by.withColumn("comment_to_post_score_ratio", F.col("mean_comment_score") / (F.abs("mean_submission_score") + 1))


def moderation(comments: DataFrame, submissions: DataFrame) -> DataFrame:
    rows = _both(comments, submissions, "banned_at_utc", "removed_by_category", "controversiality")
    is_comment = F.col("kind") == "comment"
    return rows.groupBy("author").agg(
        F.avg(F.col("banned_at_utc").isNotNull().cast("int")).alias("banned_post_ratio"),
        (F.count_if(~is_comment & (F.col("removed_by_category") == "moderator")) / F.greatest(F.count_if(~is_comment), F.lit(1))).alias("submission_mod_removed_ratio"),
        F.avg(F.when(is_comment, F.coalesce("controversiality", F.lit(0)))).alias("controversiality_mean"),
    )


def _entropy_of(counts: DataFrame, key: str, n: str) -> list[Column]:
    """Aggregates over (key, n) rows: log2 entropy from sums, so that no group is gathered: log2 N - sum(n log2 n) / N."""
    total = F.sum(n)
    return [total.alias("total"), F.max(n).alias("most"), F.count(F.lit(1)).alias("kinds"), F.greatest(F.log2(total.cast("double")) - F.sum(F.col(n) * F.log2(F.col(n).cast("double"))) / total, F.lit(0.0)).alias("entropy")]


def communities(comments: DataFrame, submissions: DataFrame) -> DataFrame:
    rows = _both(comments, submissions, "subreddit", "over_18")
    counts = rows.where("subreddit IS NOT NULL").groupBy("author", "subreddit").agg(F.count(F.lit(1)).alias("n"))
    by = counts.groupBy("author").agg(*_entropy_of(counts, "author", "n"))
    adult = rows.groupBy("author").agg((F.count_if((F.col("kind") == "submission") & F.coalesce("over_18", F.lit(False))) / F.greatest(F.count_if(F.col("kind") == "submission"), F.lit(1))).alias("nsfw_subreddit_ratio"))
    return by.join(adult, "author").select("author", F.col("kinds").alias("num_unique_subreddits"), (F.col("most") / F.col("total")).alias("top_subreddit_concentration"), F.col("entropy").alias("subreddit_entropy"), "nsfw_subreddit_ratio")


def texts(comments: DataFrame, submissions: DataFrame) -> DataFrame:
    """(author, text): comments that aren't empty or placeholders; titles with selftexts, placeholders left out."""
    body = comments.where((F.col("body") != "") & ~F.col("body").isin(*NO_TEXT)).select("author", F.col("body").alias("text"))
    inner = F.when(~F.col("selftext").isin(*NO_TEXT), F.col("selftext"))
    post = submissions.select("author", F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce(inner, F.lit("")))).alias("text")).where("text <> ''")
    return body.union(post).where("author IS NOT NULL")


def stylometry(comments: DataFrame, submissions: DataFrame) -> DataFrame:
    """Style of all texts of an author. The ratio of different words comes from a count per author and word, repetition from a
    count per author and text, so neither gathers an author's texts."""
    rows = texts(comments, submissions)
    t = F.col("text")
    per = rows.select("author", F.length(t).alias("len"), Y.upper_count(t).alias("up"), Y.letter_count(F.lower(t)).alias("letters"), F.size(U.extract_urls(t)).alias("urls"), Y.count_of(t, "^").alias("carets"), Y.count_of(t, "*").alias("stars"), Y.longest_run(t, "^").alias("caret_run"), Y.longest_run(t, "*").alias("star_run"), Y.space_entropy(t).alias("ws"))
    by = per.groupBy("author").agg(F.avg("len").alias("mean_text_length"), (F.sum("up") / F.greatest(F.sum("letters"), F.lit(1))).alias("uppercase_ratio"), F.avg("urls").alias("url_density"), F.avg("carets").alias("caret_count_mean"), F.avg("stars").alias("asterisk_count_mean"), F.max("caret_run").alias("max_consecutive_carets"), F.max("star_run").alias("max_consecutive_asterisks"), F.avg("ws").alias("whitespace_entropy"))
    words = rows.select("author", F.explode(Y.ascii_words(t)).alias("w")).groupBy("author", "w").agg(F.count(F.lit(1)).alias("n")).groupBy("author").agg((F.count(F.lit(1)) / F.sum("n")).alias("type_token_ratio"))
    again = rows.groupBy("author", F.xxhash64(F.lower(F.trim(t))).alias("h")).agg(F.count(F.lit(1)).alias("n")).groupBy("author").agg((F.sum(F.col("n") - 1) / F.sum("n")).alias("repetition_ratio"))
    return by.join(words, "author", "left").join(again, "author", "left").withColumn("type_token_ratio", F.coalesce("type_token_ratio", F.lit(0.0)))


def author_urls(comments: DataFrame, submissions: DataFrame) -> DataFrame:
    """(author, domain): one row per URL in bodies and selftexts and per link of a submission; the domain as a character-set
    strip leaves it."""
    link = F.when(F.col("url").startswith("http"), F.array("url")).otherwise(F.array().cast("array<string>"))
    urls = comments.select("author", U.extract_urls("body").alias("u")).union(submissions.select("author", F.concat(U.extract_urls("selftext"), F.coalesce(link, F.array().cast("array<string>"))).alias("u")))
    return urls.where("author IS NOT NULL").select("author", F.explode("u").alias("url")).select("author", U.domain_by_set("url").alias("domain")).where("domain <> ''")


def links(comments: DataFrame, submissions: DataFrame, whitelist: DataFrame) -> DataFrame:
    """whitelist: (domain), domains stripped alike. Authors without a domain have no row."""
    counts = author_urls(comments, submissions).groupBy("author", "domain").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(whitelist.select("domain").distinct().withColumn("known", F.lit(True)), "domain", "left")
    by = counts.groupBy("author").agg(F.sum(F.when(F.col("known"), 0).otherwise(F.col("n"))).alias("odd"), *_entropy_of(counts, "author", "n"))
    return by.select("author", (F.col("odd") / F.col("total")).alias("suspicious_url_ratio"), F.col("entropy").alias("url_domain_entropy"))


def names(authors: DataFrame) -> DataFrame:
    s = Y.name_shape("author")
    return authors.select("author").distinct().select("author", s.alias("s")).select("author", F.col("s.length").alias("username_length"), F.col("s.digit_ratio").alias("username_digit_ratio"), F.col("s.entropy").alias("username_entropy"), F.col("s.ends_with_digit").alias("username_has_digits_at_end"), F.col("s.has_underscore").alias("username_has_underscore"))


def join_features(groups: list[DataFrame], how: str = "left") -> DataFrame:
    return reduce(lambda a, b: a.join(b, "author", how), groups)


def domain_coverage(counts: DataFrame, target: float = 0.9) -> DataFrame:
    """(domain, n, rank, coverage, needed): domains by count, the share of all that they and those before cover, and whether a
    domain is among the least number of them that covers target. counts: (domain, n), one row per domain.

    Ranks and running sums come from ranges of the order, so no single task sorts all domains."""
    total = counts.agg(F.sum("n").alias("total"))
    rows = numbered(counts.select("domain", "n"), [F.desc("n"), F.col("domain")], "n").crossJoin(F.broadcast(total))  # total is one row
    return rows.select("domain", "n", F.col("place").cast("long").alias("rank"), (F.col("upto") / F.col("total")).alias("coverage"), ((F.col("upto") - F.col("n")) / F.col("total") < target).alias("needed"))
