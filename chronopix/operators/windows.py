"""Sequence operators: steps, gaps, runs, neighbours, spectra in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def top_frequency(df: DataFrame, keys: list[str], t: str) -> DataFrame:
    """fmax = 0.5 / median positive step, or span / n where there is none. t in seconds."""
    step = F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(t))
    steps = df.select(*keys, t, step.alias("_step"))
    agg = steps.groupBy(*keys).agg(F.median(F.when(F.col("_step") > 0, F.col("_step"))).alias("_med"), F.max(t).alias("_b"), F.min(t).alias("_a"), F.count(F.lit(1)).alias("_n"))
    dt = F.coalesce("_med", (F.col("_b") - F.col("_a")) / F.col("_n"))
    return agg.select(*keys, dt.alias("dt_median"), (0.5 / F.greatest(dt, F.lit(1e-12))).alias("fmax"))


def gap_indices(df: DataFrame, keys: list[str], t: str, valid: str) -> DataFrame:
    """regular = sum l^2 / span^2 and periodic = |sum l e^(2 pi i tau)|^2 / span^2 over gaps l between valid dates.

    The span is that of all dates, tau a gap's middle in it; NULL with under two valid dates or no span.
    """
    spans = df.groupBy(*keys).agg(F.min(t).alias("_a"), (F.max(t) - F.min(t)).alias("_span"))
    good = df.filter(F.col(valid))
    before = F.lag(t).over(Window.partitionBy(*keys).orderBy(t))
    gaps = good.select(*keys, F.col(t).alias("_t"), before.alias("_p")).filter("_p IS NOT NULL").join(spans, keys)
    length, tau = F.col("_t") - F.col("_p"), ((F.col("_t") + F.col("_p")) / 2 - F.col("_a")) / F.col("_span")
    wave = gaps.filter("_span > 0").select(*keys, "_span", length.alias("_l"), tau.alias("_tau"))
    sums = wave.groupBy(*keys).agg(
        F.sum(F.col("_l") * F.col("_l")).alias("_s"), F.sum(F.col("_l") * F.cos(2 * F.pi() * F.col("_tau"))).alias("_c"),
        F.sum(F.col("_l") * F.sin(2 * F.pi() * F.col("_tau"))).alias("_i"), F.first("_span").alias("_w"),
    )
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    sq = F.col("_w") * F.col("_w")
    found = sums.select(*keys, unit(F.col("_s") / sq).alias("gap_regular"), unit((F.col("_c") ** 2 + F.col("_i") ** 2) / sq).alias("gap_periodic"))
    return spans.select(*keys).join(found, keys, "left")


def difference_weights(df: DataFrame, keys: list[str], t: str) -> DataFrame:
    """1 / sqrt(max(days since the date before, 1)); NULL on the first date. t in seconds."""
    days = (F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(t))) / 86400.0
    return df.withColumn("weight", F.when(days.isNotNull(), 1 / F.sqrt(F.greatest(days, F.lit(1.0)))))


def breaks(df: DataFrame, keys: list[str], position: str, miss: str, rmse: str, run: int = 6) -> DataFrame:
    """Breaks where `run` observations in a row miss by over 2 rmse; the count starts anew after each.

    Rows without a miss (NULL) are passed over; a break's position is that of the run-th row less run - 1.
    """
    w = Window.partitionBy(*keys).orderBy(position)
    rows = df.filter(F.col(miss).isNotNull()).withColumn("_far", F.abs(miss) > 2 * F.col(rmse))
    rows = rows.withColumn("_island", F.sum(F.when(F.col("_far"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.row_number().over(Window.partitionBy(*keys, "_island", "_far").orderBy(position))
    hits = rows.filter("_far").withColumn("_k", inside).filter(F.col("_k") % run == 0)
    return hits.select(*keys, F.greatest(F.lit(0), F.col(position) - (run - 1)).cast("long").alias("break_position"))


def temporal_rmse(df: DataFrame, keys: list[str], t: str, value: str, target: float, n: int) -> DataFrame:
    """Population deviation of the n values nearest by day of year; NULL with fewer."""
    near = F.row_number().over(Window.partitionBy(*keys).orderBy(C.day_of_year_gap(t, F.lit(target)), t))
    rows = df.filter(F.col(value).isNotNull()).withColumn("_k", near).filter(F.col("_k") <= n)
    return rows.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= n, F.stddev_pop(value)).alias("temporal_rmse"))


def top_power(df: DataFrame, keys: list[str], f: str, power: str, k: int, share: float) -> DataFrame:
    """Bins by falling power until k are taken or the share of all power is reached, the one that reaches it included."""
    w = Window.partitionBy(*keys).orderBy(F.desc(power), f)
    before = F.coalesce(F.sum(power).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = df.withColumn("_rank", F.row_number().over(w)).withColumn("_before", before).withColumn("_all", F.sum(power).over(Window.partitionBy(*keys)))
    return rows.filter((F.col("_rank") == 1) | ((F.col("_rank") <= k) & (F.col("_before") < share * F.col("_all")))).drop("_before", "_all").withColumnRenamed("_rank", "rank")


def direct_spectrum(df: DataFrame, keys: list[str], t: str, value: str, modes: int, scale: float = 1.0) -> DataFrame:
    """K1 in SQL: keys, k, freq, power for k < modes / 2. Partial sums run before the shuffle, so a pixel's rows stay put."""
    span = df.groupBy(*keys).agg(F.min(t).alias("_a"), (F.max(t) - F.min(t)).alias("_w")).filter("_w > 0")
    half = (modes + modes % 2) // 2
    x = 2 * F.pi() * (F.col(t) - F.col("_a")) / F.col("_w") - F.pi()
    rows = df.join(span, keys).select(*keys, "_w", x.alias("_x"), (F.col(value) / scale).alias("_y"), F.explode(F.sequence(F.lit(0), F.lit(half - 1))).alias("k"))
    sums = rows.groupBy(*keys, "k").agg(F.sum(F.col("_y") * F.cos(F.col("k") * F.col("_x"))).alias("_re"), F.sum(F.col("_y") * F.sin(F.col("k") * F.col("_x"))).alias("_im"), F.first("_w").alias("_w"))
    return sums.select(*keys, "k", (F.col("k") / F.col("_w")).alias("freq"), (F.col("_re") ** 2 + F.col("_im") ** 2).alias("power"))


def snapped(spectrum: DataFrame, keys: list[str], target: float, f: str = "freq", power: str = "power") -> DataFrame:
    """M7: the bin within one spacing of target with the most power times sinc squared."""
    w = Window.partitionBy(*keys).orderBy(f)
    steps = spectrum.withColumn("_d", F.col(f) - F.lag(f).over(w)).filter("_d > 0")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_d"))
    df_ = steps.select(*keys, "_d", rank.alias("_r"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n")).filter(F.col("_r") == F.floor(F.col("_n") / 2) + 1)
    near = spectrum.join(df_.select(*keys, F.col("_d").alias("_df")), keys).withColumn("_gap", F.abs(F.col(f) - target)).filter((F.col(f) > 0) & (F.col("_gap") <= F.col("_df")))
    score = F.col(power) * F.pow(C.sinc(F.col("_gap") / F.col("_df")), 2)
    return near.groupBy(*keys).agg(F.max_by(f, F.struct(score, -F.col(f))).alias("snapped"))


def peaks_refined(spectrum: DataFrame, keys: list[str], f: str = "freq", power: str = "power") -> DataFrame:
    """M6: each bin with the place of its parabola's extreme."""
    w = Window.partitionBy(*keys).orderBy(f)
    p0, p2, f2 = F.lag(power).over(w), F.lead(power).over(w), F.lead(f).over(w)
    bend = p0 - 2 * F.col(power) + p2
    moved = F.when(bend != 0, F.col(f) + 0.5 * (p0 - p2) / bend * (f2 - F.col(f)))
    return spectrum.withColumn("refined", F.coalesce(moved, F.col(f)))
