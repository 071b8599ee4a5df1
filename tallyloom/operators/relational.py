"""Set, order and sample operators on plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keep_members(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows whose key is a member. The side is broadcast by the optimiser if its size allows, and shuffled otherwise."""
    return rows.join(members.select(key).distinct(), key, "left_semi")


def drop_members(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows whose key is no member, those with a null key among them."""
    return rows.join(members.select(key).distinct(), key, "left_anti")


def first_by(rows: DataFrame, key: str, order: list[str], last: bool = False) -> DataFrame:
    """One row per non-null key, the first (or last) in the order given, nulls after all values either way; ties fall to the row
    of least (greatest) columns. No key is lost. An aggregate, so a hot key is combined before the shuffle."""
    rest = [c for c in rows.columns if c != key and c not in order and not isinstance(rows.schema[c].dataType, T.MapType)]
    flag = F.isnotnull if last else F.isnull
    whole = F.struct(*[x for c in (*order, *rest) for x in (flag(F.col(c)).alias(f"{c}_"), F.col(c).alias(c))])
    pick = (F.max if last else F.min)(whole).alias("x")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(pick).select(key, *[F.col(f"x.{c}").alias(c) for c in rows.columns if c != key])


def merge_right_first(base: DataFrame, full: DataFrame, key: str, fill: dict[str, Column]) -> DataFrame:
    """full, and the rows of base whose key full hasn't, with the columns that base lacks from fill."""
    rest = base.join(full.select(key).distinct(), key, "left_anti")
    rest = rest.select(*[F.col(c) if c in base.columns else fill.get(c, F.lit(None)).alias(c) for c in full.columns])
    return full.unionByName(rest)


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows of least hash of the key: the same whatever the partitioning."""
    return rows.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), key).limit(n)


def bernoulli_sample(rows: DataFrame, key: str, part: float, most: int | None = None, seed: int = 42) -> DataFrame:
    """Rows whose key's hash falls below the part, at most `most` of them, those of least hash."""
    h = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    picked = rows.withColumn("h_", h).where(F.col("h_") < part)
    return (picked if most is None else picked.orderBy("h_", key).limit(most)).drop("h_")


def quota_sample(rows: DataFrame, group: str, key: str, total: int, seed: int = 42) -> DataFrame:
    """At most max(1, total // groups) rows of each group, those of least hash of the key. Of a hot group each task keeps its own
    least before the shuffle."""
    groups = rows.select(group).distinct().count()
    quota = max(1, total // max(groups, 1))
    w = W.partitionBy(group).orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), key)
    return rows.withColumn("k_", F.row_number().over(w)).where(F.col("k_") <= quota).drop("k_")


def numeric_columns(rows: DataFrame, pattern: str | None = None) -> list[str]:
    import re

    return [f.name for f in rows.schema if isinstance(f.dataType, T.NumericType) and (pattern is None or re.search(pattern, f.name))]


def column_profile(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per numeric column: count, nulls, null rate, mean, sample deviation, least, quartiles, greatest and the number of
    negative values, all from one pass."""
    names = columns or numeric_columns(rows)
    x = {c: F.col(c).cast("double") for c in names}
    each = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.count_if(F.col(c).isNull()).alias("nulls"), F.avg(x[c]).alias("mean"), F.stddev_samp(x[c]).alias("std"), F.min(x[c]).alias("min"), F.percentile(x[c], F.lit(0.25)).alias("q25"), F.percentile(x[c], F.lit(0.5)).alias("median"), F.percentile(x[c], F.lit(0.75)).alias("q75"), F.max(x[c]).alias("max"), F.count_if(x[c] < 0).alias("negatives")) for c in names]
    return rows.agg(F.array(*each).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def correlations(rows: DataFrame, columns: list[str], least: float = 0.0) -> DataFrame:
    """(a, b, r) for pairs of columns whose correlation is at least so far from zero, from one pass."""
    each = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return rows.agg(F.array(*each).alias("a")).select(F.explode("a").alias("x")).select("x.*").where(F.abs("r") >= least)
