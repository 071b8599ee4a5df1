"""Queries p8 and p9 over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.llm.mixing import mixture
from tallyloom.llm.packing import filling, pack
from tallyloom.llm.quality import text_quality
from tallyloom.llm.tokens import with_tokens
from tallyloom.session import cut, table

def text_of(name: str = "text"):
    """The text; null for null, blank and placeholder texts."""
    return F.when(~X.strip(name).isin("", *X.NO_TEXT), F.col(name))


def source_name(name: str = "source"):
    """A source in lower case with underscores between its words."""
    return X.nullif_blank(F.regexp_replace(F.lower(X.strip(name)), r"[\s-]+", "_"))


def language(name: str = "lang"):
    """A language's two letters; null if undetermined."""
    x = F.substring(F.lower(X.strip(name)), 1, 2)
    return F.when(F.lower(X.strip(name)).rlike("^[a-z]{2}([-_].*)?$"), x)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each text lies, for each capacity: tokens start .. start + size of the text."""
    texts = table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text")).where("text IS NOT NULL")
    sized = cut(with_tokens(texts, "text"))
    return pack(sized, "doc_id", "n_tokens", table(spark, sf_dir, "pack_capacities"))


def p8_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filling(p8_containers(spark, sf_dir))


# The outermost level of the mixture's tree: a parameter, as the tables name no domains. Sources that aren't listed are boards.
DOMAINS = {"board_wiki": "reference", "faq_pages": "reference", "harbour_mailing_list": "mail"}


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity what holds of any filling: the number of texts in containers; of containers above the capacity, of texts cut
    though they fit, of texts whose pieces don't follow one another from the first token to the last, and of cut texts with
    more pieces than they need: none."""
    sized = cut(with_tokens(table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text")).where("text IS NOT NULL"), "text"))
    packed = cut(pack(sized, "doc_id", "n_tokens", table(spark, sf_dir, "pack_capacities")))
    over = packed.groupBy("capacity_id", "capacity", "container").agg(F.sum("size").alias("s")).groupBy("capacity_id").agg(F.count_if(F.col("s") > F.col("capacity")).alias("overfull"))
    each = packed.groupBy("capacity_id", "capacity", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("s"), F.max(F.col("start") + F.col("size")).alias("end"), F.countDistinct("start").alias("starts")).join(sized, "doc_id", "left")
    whole = F.coalesce((F.col("s") == F.col("n_tokens")) & (F.col("end") == F.col("n_tokens")) & (F.col("starts") == F.col("pieces")), F.lit(False))
    by = each.groupBy("capacity_id", "capacity").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if((F.col("n_tokens") <= F.col("capacity")) & (F.col("pieces") > 1)).alias("cut_needlessly"), F.count_if(~whole).alias("incomplete"), F.count_if(F.col("pieces") > F.ceil(F.col("n_tokens") / F.col("capacity"))).alias("too_many_pieces"))
    return by.join(over, "capacity_id")


def _sized_sources(spark: SparkSession, sf_dir: str, domains: dict[str, str] = DOMAINS, others: str = "boards") -> tuple[DataFrame, DataFrame]:
    texts = table(spark, sf_dir, "documents").select("doc_id", source_name().alias("source"), language().alias("lang"), text_of().alias("text")).where("text IS NOT NULL AND source IS NOT NULL")
    goals = table(spark, sf_dir, "mix_targets").withColumn("source", source_name())
    wanted = texts.join(F.broadcast(goals.select("source").distinct()), "source", "left_semi")  # mix_targets never grows
    kind = F.lit(others)
    for source, name in domains.items():
        kind = F.when(F.col("source") == source, name).otherwise(kind)
    return with_tokens(wanted.select("doc_id", "source", kind.alias("domain"), "lang", F.md5("text").alias("hash"), "text"), "text"), goals


def _mixed(spark: SparkSession, sf_dir: str, total: int | None = None, stretch: float = 0.0) -> tuple[DataFrame, DataFrame]:
    sized, goals = _sized_sources(spark, sf_dir)
    return mixture(sized, goals, "doc_id", "source", ("domain", "lang"), "n_tokens", "hash", total, stretch=stretch)


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p9_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target whether it has documents, whether no text is used more often than allowed, and whether the tokens reached are as
    near to the budget as whole texts allow: half the longest text in each leaf of the source."""
    sized, goals = _sized_sources(spark, sf_dir)
    sized = cut(sized)
    chosen, shares = mixture(sized, goals, "doc_id", "source", ("domain", "lang"), "n_tokens", "hash")
    uses = chosen.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.max("n").alias("most"))
    slack = sized.groupBy("source", "lang").agg(F.max("n_tokens").alias("m")).groupBy("source").agg(F.sum(F.col("m") / 2 + 1).alias("slack"))
    rows = shares.join(uses, "source", "left").join(slack, "source", "left")
    near = F.abs(F.col("tokens") - F.col("budget_tokens")) <= F.coalesce("slack", F.lit(0.0))
    return rows.select("source", "target_share", "max_repeats", (F.col("available_tokens") > 0).alias("has_documents"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), near.alias("near_budget"))


def p9_stretched_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of a mixture of ten million tokens, and of ten times the greatest total at which every source gets its share
    where that is more, so that small sources can't give their part at any size."""
    return _mixed(spark, sf_dir, 10_000_000, 10.0)[1]


def p10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"), language().alias("lang")).where("text IS NOT NULL")
    return text_quality(texts, "doc_id", "text", "lang", table(spark, sf_dir, "common_words"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_quality(spark, sf_dir).where("outlying_share > 0.5").select("doc_id")


_S = "'" + X.SPACES + "'"
SQL_TEXTS = f"(SELECT doc_id, source, lang, text FROM documents WHERE text IS NOT NULL AND trim(text, {_S}) NOT IN ('', '[deleted]', '[removed]'))"
_SOURCE = f"nullif(regexp_replace(lower(trim(source, {_S})), '[\\s-]+', '_', 'g'), '')"
SQL = {
    "p8_invariants": f"""SELECT capacity_id, capacity_tokens::BIGINT AS capacity, n_documents, 0::BIGINT AS overfull, 0::BIGINT AS cut_needlessly, 0::BIGINT AS incomplete, 0::BIGINT AS too_many_pieces
FROM pack_capacities, (SELECT count(*) AS n_documents FROM {SQL_TEXTS}) WHERE capacity_tokens >= 1""",
    "p9_invariants": f"""SELECT source, target_share, max_repeats, source IN (SELECT {_SOURCE} FROM {SQL_TEXTS} WHERE {_SOURCE} IS NOT NULL) AS has_documents, true AS within_repeats, true AS near_budget
FROM (SELECT {_SOURCE} AS source, target_share, max_repeats FROM mix_targets WHERE target_share > 0 AND max_repeats > 0)""",
}
QUERIES = {"p8_containers": p8_containers, "p8_filling": p8_filling, "p8_invariants": p8_invariants, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_stretched_shares": p9_stretched_shares, "p9_invariants": p9_invariants, "p10_found": p10_found, "p10_quality": p10_quality}
