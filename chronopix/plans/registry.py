"""A registry of queries and their SQL, and the views of the tables that they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dataflow

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BANDS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str):
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    c = F.col(ts)
    return (F.datediff(c, F.lit("1970-01-01").cast("date")) * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.expr(f"extract(SECOND FROM {ts})")).cast("double")


def day(ts: str):
    """Whole days since 1970."""
    return F.datediff(F.col(ts), F.lit("1970-01-01").cast("date")).cast("double")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as joint-grid observations: a pixel per supplier, a date per ship date, four bands."""
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", *BANDS)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with duplicate dates collapsed."""
    return dataflow.collapse_duplicates(observations(spark, sf_dir), ["l_suppkey", "l_shipdate"], BANDS)


def series(spark: SparkSession, sf_dir: str, values: list[str] | None = None) -> DataFrame:
    """A supplier a row: t (days), y, and the last date as target."""
    s = dataflow.to_series(daily(spark, sf_dir), ["l_suppkey"], day("l_shipdate"), values or BANDS)
    return s.withColumn("target", F.element_at("t", -1))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as single-band observations: user_id, event_type, t (seconds), value."""
    return table(spark, sf_dir, "events").select("user_id", "event_type", "ts", seconds("ts").alias("t"), "value")


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = readings(spark, sf_dir).withColumn("d", F.col("t") / 86400.0)
    return dataflow.to_series(s, ["user_id", "event_type"], "d", ["value"]).withColumn("target", F.element_at("t", -1))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines' sums compare equal."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])
