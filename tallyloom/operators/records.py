"""Rows with one id become one record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.session import cut


def one_per_id(df: DataFrame, key: str = "id", **kept: Column) -> DataFrame:
    """One row (key, *kept) per key; rows whose key is null are left out.

    Copies of a record may be spelled differently, so the kept columns should be in their normal form. Of copies that
    still differ the smallest wins, column by column in the order given, nulls last; the choice depends on nothing but
    the rows. The aggregate is combined before the shuffle, which carries only the kept columns.
    """
    names = list(kept)
    rows = df.select(F.col(key).alias(key), *[c.alias(n) for n, c in kept.items()]).where(F.col(key).isNotNull())
    # a null sorts first in a struct; the flag before each value turns that round
    ranked = F.struct(*[x for n in names for x in (F.col(n).isNull().alias(f"{n}_"), F.col(n).alias(n))])
    return rows.groupBy(key).agg(F.min(ranked).alias("kept")).select(key, *[F.col(f"kept.{n}").alias(n) for n in names])


def numbered(rows: DataFrame, order: list[Column], total: str | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """rows with place, from 1 in the order given, and with upto, the running sum of the column total, if named; with `within`, for
    each combination of these columns, none of them null, on its own. Rows are spread by ranges of the order; each range adds the number and sum of those
    before it, so no task orders all rows, nor all rows of one key."""
    spread = cut(rows.repartitionByRange(*within, *order).withColumn("p_", F.spark_partition_id()))
    sums = [F.count(F.lit(1)).alias("m_"), (F.sum(total) if total else F.lit(0)).alias("s_")]
    line = W.partitionBy(*(within or [F.lit(0)])).orderBy("p_").rowsBetween(W.unboundedPreceding, W.currentRow)  # one row per range
    before = spread.groupBy(*within, "p_").agg(*sums).select(*within, "p_", (F.sum("m_").over(line) - F.col("m_")).alias("m_"), (F.sum("s_").over(line) - F.col("s_")).alias("s_"))
    inside = W.partitionBy(*within, "p_").orderBy(*order)
    out = spread.join(before, [*within, "p_"]).withColumn("place", F.col("m_") + F.row_number().over(inside))
    if total:
        out = out.withColumn("upto", F.col("s_") + F.sum(total).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return out.drop("p_", "m_", "s_")
