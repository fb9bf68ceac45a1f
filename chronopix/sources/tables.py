"""CSV and JSON tables of evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the tables.
SITES = "id string, lon double, lat double"
CURVES = "sample_idx long, scene_id long, scene_lon double, scene_lat double, row int, col int, n_times int, valid_count int, target_index int, kind string, time_index int, time_epoch double, time_day double, time_year double, band string, observed double, vector double, hants double, zhu2015 double"
SUMMARY = "section string, scene string, method string, product string, band_or_index string, class_kind string, class_name string, truth_class string, pred_class string, n long, valid_ratio double, fraction double, bias double, mae double, rmse double, std double, median double, p05 double, p95 double, min double, max double"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S20."""
    return spark.read.csv(path, header=True, schema=schema)


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """W9-W11, W14, W16; files=1 for small reports."""
    (df.coalesce(files) if files else df).write.mode("overwrite").csv(path, header=True)


def prediction_rows(errors: DataFrame, keys: list[str], bands: list[int]) -> DataFrame:
    """A row per pixel: keys, gap indices, truth_<band> and pred_<band>."""
    values = [F.max(F.when(F.col("band") == b, F.col(k))).alias(f"{k}_{b}") for k in ("truth", "pred") for b in bands]
    return errors.filter("status = 'evaluated'").groupBy(*keys, "gap_regular", "gap_periodic").agg(*values)


def curve_rows(observed: DataFrame, target: DataFrame, curve: DataFrame) -> DataFrame:
    """The three kinds of rows of a curve file, missing columns as NULL."""
    tag = lambda df, kind: df.withColumn("kind", F.lit(kind))
    return tag(observed, "observed").unionByName(tag(target, "target"), allowMissingColumns=True).unionByName(tag(curve, "curve"), allowMissingColumns=True)


def index_manifest(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """valid_pixels, mean and std (population) of each index."""
    return df.groupBy(*by).agg(F.count(value).alias("valid_pixels"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def difference(pred: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Pred - truth, NULL where either is missing."""
    return pred.join(truth, keys).withColumn("value", F.col("pred") - F.col("truth"))


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; more than `most` rows raise."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has {most} rows at most")
    show = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows]) + "\n"


def kept_target(spark: SparkSession, path: str, scene: str, key: str) -> str | None:
    """A target time kept for (scene, key)."""
    try:
        known = spark.read.parquet(path)
    except Exception as e:  # a table not written yet
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    row = known.filter((F.col("scene") == scene) & (F.col("key") == key)).orderBy(F.desc("stored")).first()
    return row.ts if row else None


def keep_target(spark: SparkSession, path: str, scene: str, key: str, ts: str) -> None:
    spark.createDataFrame([(scene, key, ts)], "scene string, key string, ts string").withColumn("stored", F.current_timestamp()).write.mode("append").parquet(path)
