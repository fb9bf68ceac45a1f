"""Error aggregates: metrics, bins, confusion, gap curves, robust scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def error_aggregates(e: Column | str) -> list[Column]:
    """N, bias, mae, mse, rmse; partial sums combine before the shuffle."""
    e = C.col(e)
    return [F.count(e).alias("n"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse")]


def prediction_errors(pred: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Errors where both are there; pred has column pred, truth column truth."""
    both = pred.join(truth, keys).filter(F.col("pred").isNotNull() & F.col("truth").isNotNull())
    return both.withColumn("error", F.col("pred") - F.col("truth"))


def error_metrics(errors: DataFrame, by: list[str], pooled: bool = True) -> DataFrame:
    """Metrics per group, and of all rows together (a group of NULLs) with pooled."""
    grouped = errors.rollup(*by) if pooled and by else errors.groupBy(*by)
    out = grouped.agg(*error_aggregates("error"), F.grouping_id().alias("_level") if pooled and by else F.lit(0).alias("_level"))
    levels = [0, 2 ** len(by) - 1] if pooled and by else [0]
    return out.filter(F.col("_level").isin(levels)).drop("_level")


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """N, valid_ratio, bias, mae, rmse, std, median, p05, p95, min, max; exact percentiles, linear between ranks."""
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), (F.count(v) / F.count(F.lit(1))).alias("valid_ratio"), F.avg(v).alias("bias"), F.avg(F.abs(v)).alias("mae"), F.sqrt(F.avg(v * v)).alias("rmse"),
        F.stddev_pop(v).alias("std"), F.median(v).alias("median"), F.percentile(v, F.lit(0.05)).alias("p05"), F.percentile(v, F.lit(0.95)).alias("p95"), F.min(v).alias("min"), F.max(v).alias("max"),
    )


def error_bins(errors: DataFrame, by: list[str], e: str = "error", bins=C.RAW_ERROR_BINS) -> DataFrame:
    """Count and share of each bin of |error|, bins without rows included."""
    spark = errors.sparkSession
    labels = spark.createDataFrame([(label, i) for i, (_, label) in enumerate(bins)], "bin string, bin_no int")
    counts = errors.filter(F.col(e).isNotNull()).groupBy(*by, C.error_bin(e, bins).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    groups = counts.groupBy(*by).agg(F.sum("c").alias("total"))
    full = groups.crossJoin(F.broadcast(labels)).join(counts, [*by, "bin"], "left")  # six labels for each group
    return full.select(*by, "bin", F.coalesce("c", F.lit(0)).cast("long").alias("n"), (F.coalesce("c", F.lit(0)) / F.col("total")).alias("fraction"))


def confusion(df: DataFrame, by: list[str], truth: str, pred: str, classes=C.INDEX_CLASSES) -> DataFrame:
    """Rows of each truth and predicted class, zero cells included."""
    spark = df.sparkSession
    names = [label for _, label in classes]
    cells = spark.createDataFrame([(a, b) for a in names for b in names], "truth_class string, pred_class string")
    both = df.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull())
    counts = both.groupBy(*by, C.index_class(truth, classes).alias("truth_class"), C.index_class(pred, classes).alias("pred_class")).agg(F.count(F.lit(1)).alias("c"))
    groups = counts.groupBy(*by).agg(F.sum("c").alias("total"))
    full = groups.crossJoin(F.broadcast(cells)).join(counts, [*by, "truth_class", "pred_class"], "left")  # 25 cells for each group
    return full.select(*by, "truth_class", "pred_class", F.coalesce("c", F.lit(0)).cast("long").alias("n"), (F.coalesce("c", F.lit(0)) / F.col("total")).alias("fraction"))


def gap_curves(errors: DataFrame, gap: str, bins: int = 20, band: str = "band", e: str = "error") -> DataFrame:
    """Rmse and mae by gap bin, per band and over all bands (band NULL)."""
    rows = errors.filter(F.col(gap).isNotNull()).withColumn("bin", C.gap_bin(gap, bins))
    agg = rows.groupingSets([["bin", band], ["bin"]], "bin", band).agg(F.count(e).alias("n"), F.sqrt(F.avg(F.col(e) * F.col(e))).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    return agg.withColumn("range_start", F.col("bin") * (0.2 / bins)).withColumn("label", C.gap_bin_label("bin", bins))


def index_errors(df: DataFrame, pred: dict[str, Column], truth: dict[str, Column], clamp: bool = False) -> DataFrame:
    """Rmse, mae and bias of each spectral index where both sides have it; df has a row per pixel."""
    p, t = C.spectral_indices(pred, clamp=clamp), C.spectral_indices(truth, clamp=clamp)
    wide = df.select(*[(p[k] - t[k]).alias(k) for k in C.INDICES])
    long = wide.unpivot([], list(C.INDICES), "index", "error").filter("error IS NOT NULL")
    return long.groupBy("index").agg(*error_aggregates("error"))


def tallies(df: DataFrame, status: str) -> DataFrame:
    """Attempted, evaluated, skipped, failed."""
    return df.agg(F.count(F.lit(1)).alias("attempted"), *[F.count_if(F.col(status) == s).alias(s) for s in ("evaluated", "skipped", "failed")])


def robust_scales(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """A4: centre = median, scale = 1.4826 MAD, the population deviation where that is not above 1e-6, at least 1e-6."""
    first = df.groupBy(*by).agg(F.median(value).alias("center"), F.stddev_pop(value).alias("_std"))
    dev = df.join(first, by).groupBy(*by).agg(F.first("center").alias("center"), F.first("_std").alias("_std"), F.median(F.abs(F.col(value) - F.col("center"))).alias("_mad"))
    mad = 1.4826 * F.col("_mad")
    return dev.select(*by, "center", F.greatest(F.when(mad > 1e-6, mad).otherwise(F.col("_std")), F.lit(1e-6)).alias("scale"))


def mad_std(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """A3: 1.4826 max(MAD, 1e-12)."""
    w = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.median(value).alias("_m"))
    return df.join(w, by).groupBy(*by).agg((1.4826 * F.greatest(F.median(F.abs(F.col(value) - F.col("_m"))), F.lit(1e-12))).alias("mad_std"))


def best_per(df: DataFrame, by: list[str], metric: str, payload: list[str]) -> DataFrame:
    """The row with the least metric of each group, with the group's least and median."""
    best = F.min_by(F.struct(*payload), F.struct(metric, *payload))
    return df.groupBy(*by).agg(F.min(metric).alias("least"), F.median(metric).alias("middle"), best.alias("best"))


def complete_pivot(df: DataFrame, keys: list[str], band: str, value: str, bands: list[str]) -> DataFrame:
    """The mean of each key and band as columns, incomplete rows dropped."""
    return df.groupBy(*keys).pivot(band, bands).agg(F.avg(value)).na.drop(subset=bands)


def merge_summaries(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of the same key, others stay."""
    values = [c for c in new.columns if c != key]
    joined = old.select(key, *[F.col(c).alias(f"_old_{c}") for c in values]).join(new.withColumn("_new", F.lit(True)), key, "full_outer")
    return joined.select(key, *[F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c) for c in values])


def lower_percentile(df: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """The order statistic floor(share (n - 1)), not interpolated."""
    w = Window.partitionBy(*by)
    rows = df.filter(F.col(value).isNotNull()).withColumn("_k", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return rows.filter(F.col("_k") == F.floor(share * (F.col("_n") - 1))).select(*by, F.col(value).alias("percentile"))
