"""URLs in texts and records, their normal forms and domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.text import col, nullif_blank

# Three patterns that differ in what ends a URL; they are not interchangeable.
URL_FEATURES = r"https?://[^\s\)\]\"\']+"
URL_DIRECT = r"https?://[^\s\)\"\']+"
URL_LINKS = r"(?i)https?://[^\s'\)\]\>]+"
# Domains left out of shared-link detection by default.
EXCLUDED_DOMAINS = ("i.imgur.com", "api.redgifs.com", "external-preview.redd.it", "reddit.com", "v.redd.it", "i.redd.it", "redgifs.com")


def extract_urls(text: Column | str, pattern: str = URL_FEATURES) -> Column:
    """All URLs of the text in order, as an array; empty for a null text."""
    return F.coalesce(F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def netloc(url: Column | str) -> Column:
    """Host with port and user as written, in lower case; "" if there is none."""
    return F.lower(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def domain_by_set(url: Column | str) -> Column:
    """Every leading "w" and "." is taken off the host, as a character set: wikipedia.org becomes ikipedia.org. Whitelist and
    features use this form on both sides."""
    return F.ltrim(netloc(url), F.lit("w."))


def domain_by_prefix(url: Column | str) -> Column:
    """The host without one leading "www."."""
    return F.regexp_replace(netloc(url), r"^www\.", "")


_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)"


def normal_url(url: Column | str) -> Column:
    """Scheme and host in lower case, no "www.", no parameters, query or fragment, no slash at the end. A link without a scheme
    gets http, one without a host keeps its path: "/r/a" becomes http:///r/a and "a.example/x" http:a.example/x."""
    u = col(url)
    part = lambda i: F.regexp_extract(u, _PARTS, i)
    scheme = F.coalesce(nullif_blank(F.lower(part(1))), F.lit("http"))
    host = F.regexp_replace(F.lower(F.substring(part(2), 3, 1 << 30)), r"^www\.", "")
    path = F.rtrim(F.regexp_replace(part(3), r";[^/]*$", ""), F.lit("/"))
    slashes = (host != "") | (scheme.isin("http", "https", "ftp") & ((path == "") | path.startswith("/")))
    return F.concat(scheme, F.lit(":"), F.when(slashes, F.lit("//")).otherwise(F.lit("")), host, path)


def url_token(url: Column | str, mode: str = "url") -> Column:
    """What a normal URL counts as: the URL itself, or with mode "domain" its host."""
    return domain_by_prefix(url) if mode == "domain" else col(url)


def _filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[nullif_blank(v) for v in values])


def record_urls(kind: T.StructType, of: Column | None = None, texts: tuple[str, ...] = ("title", "selftext", "body")) -> Column:
    """The URLs of a record of type `kind` (its columns, or the struct `of`): link columns, texts, preview images, media,
    galleries, and all of these in the records that it was cross-posted from, as deep as the type goes."""
    at = lambda name: F.col(name) if of is None else of[name]
    names = set(kind.names)
    parts = [F.array(at(c)) for c in ("url", "url_overridden_by_dest") if c in names]
    parts += [extract_urls(at(c), URL_LINKS) for c in (*texts, *(f"{t}_html" for t in texts if t != "title")) if c in names]
    if "preview" in names:
        parts.append(F.transform(at("preview")["images"], lambda i: i["source"]["url"]))
    parts += [F.array(_filled(at(c)["oembed"]["url"], at(c)["oembed"]["thumbnail_url"])) for c in ("media", "secure_media") if c in names]
    if "media_metadata" in names:
        inner = kind["media_metadata"].dataType.valueType
        part = lambda m, name: [F.get_json_object(m[name], f"$.{f}") for f in ("u", "url")] if isinstance(inner[name].dataType, T.StringType) else [m[name][f] for f in ("u", "url")]
        parts.append(F.transform(F.map_values(at("media_metadata")), lambda m: _filled(*[x for n in ("s", "p") if n in inner.names for x in part(m, n)])))
    if "crosspost_parent_list" in names:
        parent = kind["crosspost_parent_list"].dataType.elementType
        parts.append(F.flatten(F.transform(at("crosspost_parent_list"), lambda r: record_urls(parent, r, texts))))
    empty = F.array().cast("array<string>")
    return F.filter(F.flatten(F.array(*[F.coalesce(p, empty) for p in parts])), lambda u: u.isNotNull() & (u != "")) if parts else empty


def post_tokens(mode: str, url: Column, override: Column, domain: Column, texts: Column) -> Column:
    """The tokens of a link post: its main token (the domain without "www." in lower case, or the full URL) and those of the
    URLs in its texts that differ from it."""
    main = F.regexp_replace(F.lower(domain), r"^www\.", "") if mode == "domain" else F.coalesce(F.when(override != "", override), url)
    inner = extract_urls(texts, URL_DIRECT)
    inner = F.transform(inner, domain_by_prefix) if mode == "domain" else inner
    rest = F.filter(inner, lambda t: (t != "") & (F.coalesce(t != main, F.lit(True))))
    return F.concat(F.filter(F.array(main), lambda t: t.isNotNull() & (t != "")), rest)
