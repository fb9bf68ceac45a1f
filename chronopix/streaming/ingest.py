"""Daily means of arriving observations, with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_means(stream: DataFrame, keys: list[str], ts: str, value: str, late: str = "2 days") -> DataFrame:
    """keys, day, n, value: duplicates of a day are averaged; state of days before the watermark is dropped."""
    day = F.window(ts, "1 day")
    means = stream.withWatermark(ts, late).groupBy(*keys, day.alias("w")).agg(F.count(value).alias("n"), F.avg(value).alias(value))
    return means.select(*keys, F.col("w.start").alias("day"), "n", value)
