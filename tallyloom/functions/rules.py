"""Rules that tell automated accounts by name, by phrase, and words that tell a topic."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import col

# Phrases by which automated accounts name themselves.
PHRASES = (
    "i am a bot",
    "beep beep",
    "beep boop",
    "i'm a bot",
    "im a bot",
    "this is a bot",
    "automated message",
    "auto moderator",
    "automated response",
    "automatic response",
    "this action was performed automatically",
    "bot message",
)
# Those of them that the diagnosis uses.
DIAGNOSIS_PHRASES = tuple(p for p in PHRASES if p not in ("automatic response", "this action was performed automatically"))
# Names that hold "bot" by chance.
NOT_BOTS = ("bottle", "bottom", "botox", "both", "bother", "botanical", "botanic", "botswana", "bought", "boots", "booth")
# Words of money matters, and words that only look like them.
MONEY_WORDS = (
    "stock", "stocks", "invest", "investing", "investor", "finance", "financial", "market", "markets", "trading", "trader", "equity",
    "equities", "portfolio", "dividend", "valueinvest", "growthinvest",
    "wallstreet", "wall_street", "wallstreetbets", "wsb",
    "crypto", "bitcoin", "btc", "ethereum", "eth", "altcoin", "defi", "nft", "web3", "blockchain", "solana", "doge", "xrp",
    "futures", "forex", "fx", "commodity", "commodities", "etf", "mutualfund",
    "money", "cash", "wealth", "rich", "income", "salary", "budget", "debt", "credit", "loan", "mortgage", "retirement", "saving",
    "savings", "spending", "frugal", "entrepreneur", "business", "startup", "sidehustle",
)
NOT_MONEY_WORDS = (
    "livestock", "stockshow", "stockdog", "stockdogs", "stockcar", "stockcars", "stockholm", "stockton", "stocking", "stockings",
    "stockphoto", "stockphotos", "stockphotography", "marketplace", "marketing", "marketer", "marketing101", "farmersmarket",
    "fleamarket", "supermarket", "tradingcards", "tradingcard", "pokemontrades", "pokemontrading", "gameswap", "hardwareswap",
    "giftcardexchange", "cryptozoology", "cryptid", "cryptids", "wallpaper", "wallpapers", "wallart", "goldenretriever",
    "goldenretrievers", "goldfish", "goldendoodle", "goldendoodles", "goldcoast", "silverado", "silversmith", "bulldog", "bulldogs",
    "pitbull", "pitbulls", "chicagobulls",
)
PARTED = r"(^bot_|_bot$|_bot_)"


def _any_of(phrases: tuple[str, ...]) -> str:
    return r"(?U)\b(?:" + "|".join(re.escape(p).replace("\\ ", " ").replace("\\'", "'") for p in phrases) + r")\b"


def has_phrase(text: Column | str, phrases: tuple[str, ...] = PHRASES) -> Column:
    """Whether one of the phrases stands in the text between word borders, in any case; false for null."""
    return F.coalesce(F.lower(col(text)).rlike(_any_of(phrases)), F.lit(False))


def name_pattern(author: Column | str, not_bots: tuple[str, ...] = ()) -> Column:
    """Which pattern a name fits first: "exact", "bot", "mod" or "_bot"; null if none, or if it is a known false positive."""
    low = F.lower(col(author))
    return (
        F.when(low.isin(*not_bots) if not_bots else F.lit(False), F.lit(None).cast("string"))
        .when(low == "bot", "exact")
        .when(low.rlike(r"(?U)\bbot\b"), "bot")
        .when(low.rlike(r"(?U)\bmod\b"), "mod")
        .when(low.rlike(PARTED), "_bot")
    )


def name_label(author: Column | str, not_bots: tuple[str, ...] = ()) -> Column:
    """(label, label_source, label_confidence, reason) of a name by the labelling rules, which differ from name_pattern():
    names that begin with "Auto" count, and known false positives matter to the whole word "bot" only."""
    name, low = col(author), F.lower(col(author))
    spared = low.isin(*not_bots) if not_bots else F.lit(False)
    reason = (
        F.when(low == "bot", "exact")
        .when(low.rlike(r"(?U)\bbot\b") & ~spared, "whole word bot")
        .when(name.startswith("Auto"), "starts with Auto")
        .when(low.rlike(r"(?U)\bauto\b"), "whole word auto")
        .when(low.rlike(r"(?U)\bmod\b"), "whole word mod")
        .when(low.rlike(PARTED), "parted bot")
    )
    label = F.when(reason.isNotNull(), "bot").otherwise("human")
    return F.struct(label.alias("label"), F.lit("rule").alias("label_source"), F.lit(1.0).alias("label_confidence"), F.coalesce(reason, F.lit("no pattern")).alias("reason"))


def keyword_words(text: Column | str, strip: str = ".,!?-_()[]{}\":;") -> Column:
    """The distinct words of the lower-cased text, punctuation taken off their ends."""
    words = F.transform(F.split(F.trim(F.regexp_replace(F.lower(col(text)), r"(?U)\s+", " ")), " "), lambda w: F.btrim(w, F.lit(strip)))
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def keyword_class(words: Column, keywords: tuple[str, ...] = MONEY_WORDS, misleading: tuple[str, ...] = NOT_MONEY_WORDS) -> Column:
    """(is_match, keyword_count, matched, excluded): the keywords among the words, less misleading ones, of which a single one
    undoes the match."""
    bad = F.array(*map(F.lit, misleading)).cast("array<string>")
    excluded = F.array_sort(F.array_intersect(words, bad))
    matched = F.array_sort(F.array_except(F.array_intersect(words, F.array(*map(F.lit, keywords))), bad))
    return F.struct(((F.size(matched) > 0) & (F.size(excluded) == 0)).alias("is_match"), F.size(matched).alias("keyword_count"), matched.alias("matched"), excluded.alias("excluded"))


def is_active(posts: Column | str, subscribers: Column | str, least_posts: int = 1000, least_subscribers: int = 100) -> Column:
    """Whether a community has enough posts and subscribers; an unknown number isn't enough."""
    return F.coalesce((col(posts) >= least_posts) & (col(subscribers) >= least_subscribers), F.lit(False))
