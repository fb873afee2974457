"""An incremental timeline: the daily counts of a stream of rows, which batch results equal once it has ended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily(rows: DataFrame, column: str, late: str = "7 days") -> DataFrame:
    """(bucket, n) by day of a streaming DataFrame; rows later than ``late`` are not waited for."""
    at = F.col(f"`{column}`").cast("timestamp")
    counted = rows.withColumn("_at", at).withWatermark("_at", late).groupBy(F.window("_at", "1 day")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.date_format("window.start", "yyyy-MM-dd").alias("bucket"), "n")
