"""Evaluation of predicted against true rasters: the rows of reports.

Pixels are long: scene, method, row, col, band, pred, truth. A report's rows have the columns of tables.SUMMARY.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources import tables
from . import metrics

KEYS = ["scene", "method"]
SCALE = 10_000.0


def paired(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """pred (scene, method, row, col, band, value) with truth (scene, row, col, band, value): pred, truth, error; NULL where either is
    missing or not finite."""
    fine = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    both = pred.withColumnRenamed("value", "pred").join(truth.withColumnRenamed("value", "truth"), ["scene", "row", "col", "band"])
    both = both.withColumn("pred", fine(F.col("pred").cast("double"))).withColumn("truth", fine(F.col("truth").cast("double")))
    return both.withColumn("error", F.col("pred") - F.col("truth"))


def indices(pixels: DataFrame) -> DataFrame:
    """scene, method, row, col, index, pred, truth, error of the six spectral indices, NULL outside [-1, 1]."""
    at = [*KEYS, "row", "col"]
    wide = pixels.groupBy(*at).pivot("band", list(C.BANDS)).agg(F.first("pred").alias("pred"), F.first("truth").alias("truth"))
    p = C.spectral_indices({b: F.col(f"{b}_pred") for b in C.BANDS}, clamp=True)
    t = C.spectral_indices({b: F.col(f"{b}_truth") for b in C.BANDS}, clamp=True)
    pairs = F.array(*[F.struct(F.lit(k.upper()).alias("index"), p[k].alias("pred"), t[k].alias("truth")) for k in C.INDICES])
    long = wide.select(*at, F.explode(pairs).alias("x")).select(*at, "x.*")
    return long.withColumn("error", F.col("pred") - F.col("truth"))


def _rows(df: DataFrame, section: str, product, name: str) -> DataFrame:
    return df.withColumn("section", F.lit(section)).withColumn("product", product).withColumnRenamed(name, "band_or_index")


def pair_report(pixels: DataFrame) -> DataFrame:
    """V5: statistics, error bins and classes of every scene, method, band and index."""
    x = indices(pixels)
    diff, of_index = F.lit("DIFF"), F.concat(F.lit("DIFF_"), F.col("index"))
    parts = [
        _rows(metrics.summary(pixels, [*KEYS, "band"], "error"), "continuous", diff, "band"),
        _rows(metrics.summary(x, [*KEYS, "index"], "error"), "continuous", of_index, "index"),
        _rows(metrics.error_bins(pixels, [*KEYS, "band"]), "error_bin", diff, "band").withColumnRenamed("bin", "class_name").withColumn("class_kind", F.lit("abs_error")),
        _rows(metrics.error_bins(x, [*KEYS, "index"], bins=C.INDEX_ERROR_BINS), "error_bin", of_index, "index").withColumnRenamed("bin", "class_name").withColumn("class_kind", F.lit("abs_error")),
        _rows(metrics.confusion(x, [*KEYS, "index"], "truth", "pred"), "confusion", of_index, "index").withColumn("class_kind", F.lit("index_class")),
    ]
    by_class = x.filter("truth IS NOT NULL AND error IS NOT NULL").withColumn("class_name", C.index_class("truth"))
    parts.append(_rows(metrics.summary(by_class, [*KEYS, "index", "class_name"], "error"), "class", of_index, "index").withColumn("class_kind", F.lit("index_class")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(*[F.col(name).cast(kind).alias(name) for name, kind in (x.split() for x in tables.SUMMARY.split(", "))])


def site_metrics(pixels: DataFrame) -> DataFrame:
    """V6: n, bias, mae, mse, rmse of each scene and method: all bands together in reflectance, and each index."""
    reflectance = pixels.withColumn("e", F.col("error") / SCALE).groupBy(*KEYS).agg(*metrics.error_aggregates("e")).withColumn("of", F.lit("reflectance"))
    by_index = indices(pixels).groupBy(*KEYS, "index").agg(*metrics.error_aggregates("error")).withColumnRenamed("index", "of")
    return reflectance.unionByName(by_index).select(*KEYS, "of", "n", "bias", "mae", "mse", "rmse")
