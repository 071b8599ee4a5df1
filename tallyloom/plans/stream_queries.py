"""A stream over the comments file, run to its end."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.schema import COMMENT
from tallyloom.session import scratch
from tallyloom.streaming.replies import stream_counts


def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Comments per community and day, counted by a stream that reads what is there and stops."""
    path = f"{d}/comments.parquet"
    source = spark.readStream.schema(COMMENT)
    rows = source.parquet(path) if os.path.isdir(path) else source.option("pathGlobFilter", "comments.parquet").parquet(d)
    rows = rows.select("created_utc", X.community("subreddit").alias("subreddit")).where("subreddit IS NOT NULL")
    found, states = scratch(spark, "daily"), scratch(spark, "states")
    latest = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{found}/{number}")
        latest.append(number)

    query = stream_counts(rows, "subreddit").writeStream.outputMode("complete").option("checkpointLocation", states).foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{found}/{max(latest)}").select("subreddit", F.col("start_utc").cast("long").alias("start_utc"), "n")


_S = "'" + X.SPACES + "'"
QUERIES = {"stream_daily_counts": stream_daily_counts}
SQL = {
    "stream_daily_counts": f"SELECT subreddit, start_utc, count(*) AS n FROM (SELECT nullif(trim(regexp_replace(lower(trim(subreddit, {_S})), '^/?r/', ''), {_S}), '') AS subreddit, CAST(floor(created_utc / 86400) * 86400 AS BIGINT) AS start_utc FROM comments WHERE created_utc > 0) WHERE subreddit IS NOT NULL GROUP BY 1, 2"
}
