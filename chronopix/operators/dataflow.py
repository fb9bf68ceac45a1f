"""Steps from raw observations to series: masks, duplicates, alignment, targets, hold-outs.

Long tables have a row per pixel, time and band: keys, ts, band, value. Keys are one or more columns that name a pixel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def mask_values(df: DataFrame, value: str, low: float = C.VALID_MIN, high: float = C.VALID_MAX) -> DataFrame:
    """Values outside (low, high) become NULL."""
    return df.withColumn(value, C.masked(value, low, high))


def subsample(df: DataFrame, step: int = 8, row: str = "row", column: str = "col") -> DataFrame:
    """Every step-th row and column."""
    return df.filter((F.col(row) % step == 0) & (F.col(column) % step == 0))


def window(df: DataFrame, row0: int, col0: int, rows: int, cols: int, row: str = "row", column: str = "col") -> DataFrame:
    """A rectangle of pixels; the filters reach the scan."""
    if rows < 1 or cols < 1:
        raise ValueError("a window has at least one row and one column")
    return df.filter(F.col(row).between(row0, row0 + rows - 1) & F.col(column).between(col0, col0 + cols - 1))


def window_offset(geo: list[float], shape: tuple[int, int], size: int, lon: float | None = None, lat: float | None = None) -> tuple[int, int]:
    """The first row and column of a size x size window around a place (default: the centre), clamped to the raster."""
    rows, cols = shape
    if size < 1 or size > min(rows, cols):
        raise ValueError(f"a window of {size} does not fit {rows} x {cols}")
    if lon is None or lat is None:
        r, c = rows // 2, cols // 2
    else:
        x0, a, b, y0, d, e = geo
        det = a * e - b * d
        if det == 0:
            raise ValueError("the geotransform has no inverse")
        c = int((e * (lon - x0) - b * (lat - y0)) // det)
        r = int((a * (lat - y0) - d * (lon - x0)) // det)
    clamp = lambda v, n: max(0, min(v - size // 2, n - size))
    return clamp(r, rows), clamp(c, cols)


def collapse_duplicates(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """A5: one row per keys, the mean of what is there of each value (NULL if nothing is)."""
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def joint_rows(df: DataFrame, values: list[str]) -> DataFrame:
    """P5: rows in which every value is there."""
    return df.na.drop(subset=values)


def eligible(df: DataFrame, keys: list[str], values: list[str], least: int) -> DataFrame:
    """Pixels with at least so many joint dates, with the number."""
    there = F.lit(True)
    for v in values:
        there = there & F.col(v).isNotNull() & ~F.isnan(v)
    return df.groupBy(*keys).agg(F.count_if(there).alias("joint_valid")).filter(F.col("joint_valid") >= least)


def shared_times(df: DataFrame, ts: str, band: str, bands: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Times that every band has, or at least so many bands (relational division); with keys, of each of them."""
    if bands is None:
        every = df.agg(F.count_distinct(band).alias("_all"))
        return df.groupBy(ts).agg(F.count_distinct(band).alias("_n")).join(F.broadcast(every), F.col("_n") == F.col("_all")).select(ts)
    return df.groupBy(*keys, ts).agg(F.count_distinct(band).alias("_n")).filter(F.col("_n") >= bands).select(*keys, ts)


def align(df: DataFrame, ts: str, band: str, bands: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows at times that every band has."""
    return df.join(shared_times(df, ts, band, bands, keys), [*keys, ts], "left_semi")


def scored(df: DataFrame, scores: DataFrame, key: str, score: str, value: str, least: float = 0.8) -> DataFrame:
    """Rows whose key has a score, the first one by score where it has several; values without a score over `least` become NULL."""
    first = scores.groupBy(key).agg(F.max(score).alias("_score"))
    return df.join(first, key).withColumn(value, F.when(F.col("_score") > least, F.col(value))).drop("_score")


def found_or_missing(wanted: DataFrame, present: DataFrame, key: str, found: str = "found") -> DataFrame:
    """Wanted rows, marked by whether their key is present."""
    have = present.select(key).distinct().withColumn(found, F.lit(True))
    return wanted.join(have, key, "left").withColumn(found, F.coalesce(found, F.lit(False)))


def merge_chunks(chunks: list[DataFrame]) -> DataFrame:
    """Chunks of one band's time axis, one after the other; none is an error."""
    if not chunks:
        raise ValueError("no chunks to merge")
    out = chunks[0]
    for c in chunks[1:]:
        out = out.unionByName(c)
    return out


def relative_days(df: DataFrame, keys: list[str], t: str, name: str = "days") -> DataFrame:
    """Days since the first time of each key; t in seconds."""
    return df.withColumn(name, (F.col(t) - F.min(t).over(Window.partitionBy(*keys))) / 86400.0)


def time_axis(df: DataFrame, keys: list[str], t: str, target: str) -> DataFrame:
    """Day and target_day since the first of all times and the target; t and target in seconds.

    A time that is the target's, or a NULL one, ends the query: the masked series must not hold it.
    """
    origin = F.least(F.min(t).over(Window.partitionBy(*keys)), F.col(target))
    wrong = F.col(t).isNull() | (F.abs(F.col(t) - F.col(target)) <= 1e-6)
    day = F.when(wrong, F.raise_error(F.lit("a masked time is missing or is the target's")).cast("double")).otherwise((F.col(t) - origin) / 86400.0)
    return df.withColumn("day", day).withColumn("target_day", (F.col(target) - origin) / 86400.0)


def completeness(df: DataFrame, ts: str, band: str, value: str) -> DataFrame:
    """The share of values that are there, by time and band."""
    return df.groupBy(ts, band).agg(F.avg(F.col(value).isNotNull().cast("double")).alias("completeness"))


def validity_scores(scores: DataFrame, ts: str, band: str) -> DataFrame:
    """Least and mean completeness of each time over all bands, a missing band counting as 0, in 1e-9 units."""
    every = scores.agg(F.count_distinct(band).alias("_all"))
    by_time = scores.groupBy(ts).agg(F.min("completeness").alias("_least"), F.sum("completeness").alias("_sum"), F.count_distinct(band).alias("_n"))
    scaled = lambda c: F.round(c * 1e9).cast("long")
    return by_time.join(F.broadcast(every)).select(
        ts, scaled(F.when(F.col("_n") == F.col("_all"), F.col("_least")).otherwise(0.0)).alias("min_scaled"), scaled(F.col("_sum") / F.col("_all")).alias("mean_scaled")
    )


def select_target(scores: DataFrame, ts: str, band: str, ratio: float = 0.9, late: float = 0.25) -> DataFrame:
    """O2: one row, the target time.

    Of the last ceil(n * late) times (one at least), the newest whose every band reaches the ratio; else of the earlier
    ones; else the time with the best (least, mean) completeness, the latest on ties. Times come from an aggregate, a
    row each, so the ranks sort times and not observations.
    """
    rated = validity_scores(scores, ts, band)
    n = rated.agg(F.count(F.lit(1)).alias("_n"))
    ranked = rated.withColumn("_back", F.row_number().over(Window.orderBy(F.desc(ts)))).join(F.broadcast(n))
    passes = F.col("min_scaled") >= round(ratio * 1e9)
    tail = F.greatest(F.lit(1), F.ceil(F.col("_n") * late))
    pool = F.when(passes & (F.col("_back") <= tail), 0).when(passes, 1).otherwise(2)
    least, mean = F.when(pool == 2, F.col("min_scaled")), F.when(pool == 2, F.col("mean_scaled"))
    return ranked.orderBy(pool, F.desc_nulls_last(least), F.desc_nulls_last(mean), F.desc(ts)).limit(1).select(ts)


def hold_out(df: DataFrame, ts: str, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(training rows, truth rows) around one target time."""
    target = F.broadcast(target.select(F.col(ts).alias("_target")))
    return df.join(target, F.col(ts) == F.col("_target"), "left_anti"), df.join(target, F.col(ts) == F.col("_target"), "left_semi")


def hold_out_middle(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Marks each pixel's middle date (position size / 2, from 0) as held out."""
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(ts)) - 1
    return df.withColumn("held_out", rank == F.floor(F.count(F.lit(1)).over(w) / 2))


def to_series(df: DataFrame, keys: list[str], t: Column | str, values: list[str]) -> DataFrame:
    """A pixel a row: keys, t and y (time-sorted arrays; y holds an array per date). One shuffle on the keys."""
    obs = F.struct(C.col(t).cast("double").alias("t"), F.array(*[F.col(v).cast("double") for v in values]).alias("y"))
    series = df.groupBy(*keys).agg(F.array_sort(F.collect_list(obs)).alias("obs"))
    return series.select(*keys, F.col("obs.t").alias("t"), F.col("obs.y").alias("y"))


def pivot_bands(df: DataFrame, keys: list[str], band: str, value: str, bands: list[str]) -> DataFrame:
    """A column per band, in the given order."""
    if not bands:
        raise ValueError("a stack has at least one band")
    return df.groupBy(*keys).pivot(band, bands).agg(F.first(value, ignorenulls=True))


def unpivot_bands(df: DataFrame, keys: list[str], bands: list[str], band: str = "band", value: str = "value") -> DataFrame:
    return df.unpivot(keys, bands, band, value)


def bands_in_order(df: DataFrame, band: str) -> DataFrame:
    """O1."""
    return df.orderBy(*C.band_order(band))


def complete_locations(files: DataFrame, name: str, required: tuple[str, ...] = C.BANDS) -> DataFrame:
    """Places that have a file of every required band, by lon and lat."""
    parts = files.select(C.band_file(C.strip_chunk(F.regexp_replace(name, r"\.tif$", ""))).alias("p")).select("p.*").filter("band IS NOT NULL")
    need = F.array(*[F.lit(b) for b in required])
    found = parts.groupBy("lon", "lat").agg(F.collect_set("band").alias("bands"))
    return found.filter(F.size(F.array_except(need, "bands")) == 0).select("lon", "lat").orderBy("lon", "lat")


def band_stacks(files: DataFrame, name: str) -> DataFrame:
    """Band and its sorted paths."""
    return files.withColumn("p", C.band_file(name)).filter("p.band IS NOT NULL").groupBy(F.col("p.band").alias("band")).agg(F.array_sort(F.collect_list(name)).alias("paths"))


def carried_forward(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The last value there was, carried over dates without one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(f"{value}_carried", F.last(value, ignorenulls=True).over(w))


def interval_lookup(points: DataFrame, value: str, intervals: DataFrame, low: str, high: str) -> DataFrame:
    """Joins each value to the interval [low, high) that holds it, as an equi-join of bins.

    Bins are as wide as the mean interval, so intervals that do not overlap touch no more than two bins each on average.
    """
    width = F.broadcast(intervals.agg(F.greatest(F.lit(1.0), F.avg(F.col(high) - F.col(low))).alias("_width")))
    at = lambda c: F.floor(F.col(c) / F.col("_width"))
    last = F.floor((F.col(high) - 1) / F.col("_width"))
    binned = intervals.filter(F.col(high) > F.col(low)).join(width).withColumn("_bin", F.explode(F.sequence(at(low), last))).drop("_width")
    own = points.join(width).withColumn("_bin", at(value)).drop("_width")
    return own.join(binned, "_bin").filter((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_bin")
