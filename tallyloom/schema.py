"""Schemas of dumps; every column may be null, ids are strings, times are epoch seconds."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType()}


def _struct(text: str, **nested: T.DataType) -> T.StructType:
    """Columns from "name type, ..."; made without a session, so that this module can be imported before there is one."""
    return T.StructType([T.StructField(n, nested.get(n) or _TYPES[t]) for n, t in (c.split() for c in text.split(", "))])


COMMENT = _struct(
    "id string, name string, author string, author_fullname string, created_utc double, subreddit string, subreddit_id string, body string, link_id string, parent_id string, "
    "score bigint, distinguished string, collapsed_reason string, permalink string, source_period string, controversiality int, collapsed boolean, is_submitter boolean, banned_at_utc double"
)
SUBMISSION = _struct(
    "id string, name string, author string, author_fullname string, created_utc double, subreddit string, title string, selftext string, url string, url_overridden_by_dest string, domain string, "
    "post_hint string, permalink string, distinguished string, removed_by_category string, source_period string, score bigint, num_comments bigint, num_crossposts bigint, upvote_ratio double, "
    "is_self boolean, over_18 boolean, spoiler boolean, locked boolean, banned_at_utc double"
)
POST = T.StructType(list(COMMENT.fields) + [f for f in SUBMISSION.fields if f.name not in COMMENT.names])
COMMUNITY = _struct(
    "display_name string, id string, _meta struct, description string, public_description string, subscribers bigint, active_user_count bigint, over18 boolean, created double, lang string",
    _meta=_struct("num_posts bigint, earliest_post double, num_comments bigint"),
)
LABELED_PAIR = _struct("text_a string, text_b string, label int, pair_id string, note string")
RANK = _struct("rank int, bot_name string, score double, good_votes bigint, bad_votes bigint, comment_karma bigint, link_karma bigint")
_MEDIA = _struct("oembed struct", oembed=_struct("url string, thumbnail_url string"))
_IMAGE = _struct("source struct", source=_struct("url string"))
_EXTRA = {
    "preview": _struct("images array", images=T.ArrayType(_IMAGE)),
    "media": _MEDIA,
    "secure_media": _MEDIA,
    "media_metadata": T.MapType(T.StringType(), _struct("s struct, p string", s=_struct("u string, url string"))),  # p is an object or a list, kept as text
}


def linked(depth: int = 3) -> T.StructType:
    """Submissions with the nested columns that hold links, and the records they were cross-posted from, so many deep."""
    own = list(SUBMISSION.fields) + [T.StructField(n, t) for n, t in _EXTRA.items()]
    return T.StructType(own + ([T.StructField("crosspost_parent_list", T.ArrayType(linked(depth - 1)))] if depth else []))


EXTRAS = T.StructType([T.StructField(n, t) for n, t in _EXTRA.items()])
