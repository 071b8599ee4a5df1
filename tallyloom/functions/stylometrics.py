"""Columns that describe how a text or a name is written, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import col


def count_of(text: Column | str, char: str) -> Column:
    return F.length(col(text)) - F.length(F.replace(col(text), F.lit(char), F.lit("")))


def longest_run(text: Column | str, char: str) -> Column:
    """The length of the longest run of the character; 0 if it isn't there."""
    runs = F.regexp_extract_all(col(text), F.lit(f"\\{char}+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def upper_count(text: Column | str) -> Column:
    return F.regexp_count(col(text), F.lit(r"\p{Lu}"))


def letter_count(text: Column | str) -> Column:
    return F.regexp_count(col(text), F.lit(r"\p{L}"))


def ascii_words(text: Column | str) -> Column:
    """Whole words of a-z in the lower-cased text; combining marks end a word."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"(?<![\p{L}\p{N}_])[a-z]+(?![\p{L}\p{N}_])"), F.lit(0))


def _entropy(items: Column) -> Column:
    """Entropy in bits of an array's values; null for an empty array."""
    n = F.size(items).cast("double")
    shares = F.transform(F.array_distinct(items), lambda v: F.size(F.filter(items, lambda x: x == v)) / n)
    return F.when(n > 0, F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p)))


def space_entropy(text: Column | str) -> Column:
    """Entropy of the different runs of white space; 0 if there are none."""
    return F.coalesce(_entropy(F.regexp_extract_all(col(text), F.lit(r"(?U)\s+"), F.lit(0))), F.lit(0.0))


def name_shape(author: Column | str) -> Column:
    """(length, digit_ratio, entropy, ends_with_digit, has_underscore) of a name."""
    a = col(author)
    chars = F.filter(F.split(F.lower(a), ""), lambda c: c != "")
    return F.struct(
        F.length(a).alias("length"),
        (F.regexp_count(a, F.lit(r"\p{Nd}")) / F.greatest(F.length(a), F.lit(1))).alias("digit_ratio"),
        F.coalesce(_entropy(chars), F.lit(0.0)).alias("entropy"),
        a.rlike(r"\p{Nd}$").cast("int").alias("ends_with_digit"),
        a.contains("_").cast("int").alias("has_underscore"),
    )


def differential_entropy(sorted_values: Column) -> Column:
    """Differential entropy of a sample given as a sorted array: by van Es up to 10 values, by Ebrahimi up to 1000, by Vasicek
    above; m is floor(sqrt(n) + 0.5). Null for fewer than five values or none; ties within the window give -infinity."""
    x = sorted_values
    n = F.size(x)
    m = F.floor(F.sqrt(n.cast("double")) + 0.5).cast("int")
    d = n.cast("double")
    md = m.cast("double")
    at = lambda i: F.element_at(x, i)
    ln = lambda v: F.when(v > 0, F.ln(v)).otherwise(F.lit(float("-inf")))
    add = lambda a, b: a + b
    zero = F.lit(0.0)
    gap = lambda i: at(F.least(i + m, n)) - at(F.greatest(i - m, F.lit(1)))
    every = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    weight = lambda i: F.when(i <= m, 1 + (i - 1) / md).when(i > n - m, 1 + (n - i) / md).otherwise(F.lit(2.0))
    ebrahimi = F.aggregate(F.transform(every, lambda i: ln(d / (weight(i) * md) * gap(i))), zero, add) / d
    vasicek = F.aggregate(F.transform(every, lambda i: ln(d / (2 * md) * gap(i))), zero, add) / d
    short = F.sequence(F.lit(1), F.greatest(n - m, F.lit(1)))
    van_es = F.aggregate(F.transform(short, lambda i: ln((d + 1) / md * (at(F.least(i + m, n)) - at(i)))), zero, add) / (d - md) + F.aggregate(F.transform(F.sequence(m, F.greatest(n, m)), lambda k: 1 / k.cast("double")), zero, add) + F.ln(md) - F.ln(d + 1)
    return F.when(n < 5, F.lit(None).cast("double")).when(n <= 10, van_es).when(n <= 1000, ebrahimi).when(n > 1000, vasicek)
