"""How distinctive a term is of a record, from one contingency table per record and term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut


def _part(k: Column, expected: Column) -> Column:
    return F.when(k > 0, k * F.log(k / expected)).otherwise(F.lit(0.0))


def term_distinctiveness(rows: DataFrame, record: str, term: str) -> DataFrame:
    """(record, term, n, record_total, term_total, total, records_with_term, records, llr, weight): one row per record and
    term that occur together.

    llr is the log-likelihood ratio statistic 2 * sum k ln(k / expected) of the two-by-two table of the term's count in the
    record and in the remaining collection against all other terms' counts; it is negative where the term is rarer in the
    record than elsewhere. weight is the term's share of the record times ln(records / records with the term), from the
    same counts. Rows with a null record or term count for nothing; repeated rows count each; a collection of one record
    has llr 0 and weight 0 throughout.

    Counts are combined before each shuffle, so a record or term with a third of all rows is one row per map task. The
    totals per record and per term are joined on their keys; the grand totals are a single row.
    """
    cells = rows.select(F.col(record).alias("record"), F.col(term).alias("term")).where(F.col("record").isNotNull() & F.col("term").isNotNull())
    cells = cut(cells.groupBy("record", "term").agg(F.count(F.lit(1)).alias("n")))  # read three times below
    by_record = cells.groupBy("record").agg(F.sum("n").alias("record_total"))
    by_term = cells.groupBy("term").agg(F.sum("n").alias("term_total"), F.count(F.lit(1)).alias("records_with_term"))
    whole = by_record.agg(F.coalesce(F.sum("record_total"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("records"))
    x = cells.join(by_record, "record").join(by_term, "term").crossJoin(F.broadcast(whole))  # whole is one row
    a = F.col("n").cast("double")
    b = F.col("record_total") - a
    c = F.col("term_total") - a
    d = F.col("total") - F.col("record_total") - c
    total = F.col("total").cast("double")
    in_record, outside = F.col("record_total") / total, (F.col("total") - F.col("record_total")) / total
    has, other = F.col("term_total").cast("double"), (F.col("total") - F.col("term_total")).cast("double")
    g = 2 * (_part(a, has * in_record) + _part(b, other * in_record) + _part(c, has * outside) + _part(d, other * outside))
    sign = F.when(a < has * in_record, F.lit(-1.0)).otherwise(F.lit(1.0))
    share = a / F.col("record_total")
    weight = share * F.log(F.col("records") / F.col("records_with_term").cast("double"))
    return x.select("record", "term", "n", "record_total", "term_total", "total", "records_with_term", "records", (sign * F.greatest(g, F.lit(0.0))).alias("llr"), weight.alias("weight"))
