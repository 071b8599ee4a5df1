"""Column functions on names and free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space around a name.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Names that stand for no author.
NO_AUTHOR = ("[deleted]", "[removed]", "AutoModerator")
# Texts that stand for no text.
NO_TEXT = ("[deleted]", "[removed]")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(col(c), F.lit(SPACES))


def nullif_blank(c: Column) -> Column:
    return F.when(c != "", c)


def author(c: Column | str, none: tuple[str, ...] = NO_AUTHOR) -> Column:
    """The stripped author; null for null, blank and stand-in names."""
    s = strip(c)
    return F.when((s != "") & ~s.isin(*none), s)


def community(c: Column | str) -> Column:
    """The community's name in lower case without a leading r/ or /r/; null if blank."""
    return nullif_blank(strip(F.regexp_replace(F.lower(strip(c)), "^/?r/", "")))


def domain(c: Column | str) -> Column:
    """A link's domain in lower case without one leading "www."; null if blank or of a self post."""
    s = F.lower(strip(c))
    return nullif_blank(F.when(~s.startswith("self."), F.regexp_replace(s, r"^www\.", "")))


def collapse(c: Column | str) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def word_count(c: Column | str) -> Column:
    s = collapse(c)
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, " ")))


def preview(c: Column | str, limit: int) -> Column:
    """White space collapsed, cut to limit characters of which the last three are dots."""
    s = collapse(c)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.substring(s, 1, limit - 3), F.lit("...")))


def matched_community(wanted: list[str], name: Column | str = "subreddit", other: Column | str = "subreddit_id") -> Column:
    """The wanted community that a record belongs to: its community if that is wanted, else its community's id if that is, else
    null. Wanted names are in normal form."""
    a, b = community(name), community(other)
    return F.coalesce(F.when(a.isin(*wanted), a), F.when(b.isin(*wanted), b))


def without_parts(c: Column | str, parts: tuple[str, ...] = ("bot",), keep: tuple[str, ...] = ()) -> Column:
    """Whether a name holds none of the parts in any case; blank parts count for nothing. Names in keep always stay."""
    low = F.lower(col(c))
    ok = F.lit(True)
    for p in (p.strip().lower() for p in parts):
        ok = ok & ~low.contains(p) if p else ok
    return ok | col(c).isin(*keep) if keep else ok


def whole_numbers(text: str) -> list[int]:
    """The numbers of a list like "8, 16,32"; blank items are skipped."""
    return [int(x) for x in text.split(",") if x.strip()]
