"""Global ranks and running sums without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Keys sampled for each range: ranges are then equal within some tenth.
SAMPLED = 100


def in_ranges(df: DataFrame, order: list[Column | str], parts: int | None = None) -> DataFrame:
    """df with _span, the number of the sorted range of `order` that a row is in, rising in that order; equal keys stay together.

    Bounds are taken once, from a sample of keys, and a row's range follows from its key alone: plans that compute df again, in part or
    after a lost task, find the same ranges. Spark's range partitioner samples anew in each plan, and two samples have different bounds.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(order)])
    keys = df.select(key.alias("_key"))
    rows = [r[0] for r in keys.orderBy(F.rand()).limit(SAMPLED * n).orderBy("_key").collect()]  # SAMPLED keys a range
    bounds = spark.createDataFrame([([rows[len(rows) * i // n] for i in range(1, n)] if rows else [],)], T.StructType([T.StructField("_bounds", T.ArrayType(keys.schema[0].dataType))]))
    # the number of bounds that are not above the key
    return df.join(F.broadcast(bounds)).withColumn("_key", key).withColumn("_span", F.size(F.filter("_bounds", lambda b: b <= F.col("_key")))).drop("_key", "_bounds")


def running_sum(df: DataFrame, order: list[Column | str], value: Column | str, name: str, parts: int | None = None) -> DataFrame:
    """Adds the sum of value over the rows before each one in `order`, from sums of ranges and running sums inside them."""
    value = F.col(value) if isinstance(value, str) else value
    dealt = in_ranges(df.withColumn("_value", value), order, parts)
    spans = dealt.groupBy("_span").agg(F.sum("_value").alias("_s"))  # a row for each range
    firsts = spans.select("_span", F.coalesce(F.sum("_s").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    own = F.coalesce(F.sum("_value").over(Window.partitionBy("_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_own", own).join(F.broadcast(firsts), "_span").withColumn(name, F.col("_first") + F.col("_own")).drop("_span", "_value", "_own", "_first")


def numbered(df: DataFrame, order: list[Column | str], name: str, parts: int | None = None) -> DataFrame:
    """Adds the rank of each row, gapless from 0, in `order`."""
    return running_sum(df, order, F.lit(1), name, parts).withColumn(name, F.col(name).cast("long"))
