"""Queries that write rasters, caches and tables, read them back, and compare with the rows that went in."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dataflow as D
from ..operators import sampling
from ..operators.ranges import numbered
from ..sources import caches, rasters, tables
from .registry import query, readings, rounded, table
from .relational import RATED, TARGET

GEO = [10.0, 0.5, 0.0, 50.0, 0.0, -0.5]
ROWS, COLS = 50, 20
CELLS = "g AS (SELECT p_size - 1 AS r, p_partkey % 20 AS c, count(*) AS n, sum(p_partkey % 1000) AS s FROM part GROUP BY 1, 2)"
GRID = f"""{CELLS}, px AS (SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, b AS band_idx, CASE b WHEN 1 THEN 'B2' ELSE 'B8' END AS description,
  CAST(CASE b WHEN 1 THEN n ELSE s END AS DOUBLE) AS value FROM generate_series(0, {ROWS - 1}) y(r) CROSS JOIN generate_series(0, {COLS - 1}) x(c) CROSS JOIN (VALUES (1), (2)) z(b) LEFT JOIN g USING (r, c))"""


def _pixels(spark: SparkSession, sf: str, folder: str) -> DataFrame:
    """Parts on a grid of sizes and keys, as two bands of a raster."""
    g = table(spark, sf, "part").groupBy((F.col("p_size") - 1).cast("int").alias("row"), (F.col("p_partkey") % COLS).cast("int").alias("col")).agg(F.count(F.lit(1)).alias("B2"), F.sum(F.col("p_partkey") % 1000).alias("B8"))
    long = D.unpivot_bands(g, ["row", "col"], ["B2", "B8"])
    return long.select(F.lit(f"{folder}/grid.tif").alias("path"), "row", "col", "band", F.col("value").cast("float").alias("value"))


def _raster(spark: SparkSession, sf: str) -> str:
    folder = caches.shared_folder(spark, "raster")
    rasters.write_files(rasters.encode_stacks(_pixels(spark, sf, folder), ["path"], ["B2", "B8"], ROWS, COLS, GEO, -9999.0)).collect()
    return folder


def _values(df: DataFrame) -> DataFrame:
    return df.select("row", "col", "band_idx", "description", F.col("value").cast("double").alias("value"))


@query("w1_raster_round_trip", f"WITH {GRID} SELECT * FROM px")
def raster_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return _values(rasters.read_pixels(spark, _raster(spark, sf)))


@query("s4_raster_window", f"WITH {GRID} SELECT * FROM px WHERE row BETWEEN 10 AND 29 AND col BETWEEN 13 AND 19 AND band_idx = 2")
def raster_window(spark: SparkSession, sf: str) -> DataFrame:
    """One band of a window that is clamped at the raster's edge."""
    return _values(rasters.read_pixels(spark, _raster(spark, sf), 2, (10, 13, 20, 50)))


@query("s1_raster_headers", f"SELECT {ROWS} AS rows, {COLS} AS cols, 2 AS n_bands, [10.0, 0.5, 0.0, 50.0, 0.0, -0.5] AS geo_transform, -9999.0::DOUBLE AS nodata, ['B2', 'B8'] AS descriptions FROM (SELECT count(*) FROM part)")
def raster_headers(spark: SparkSession, sf: str) -> DataFrame:
    return rasters.read_headers(spark, _raster(spark, sf)).select("rows", "cols", "n_bands", "geo_transform", "nodata", "descriptions")


@query("s10_mosaic", f"WITH {GRID} SELECT * FROM px")
def mosaic(spark: SparkSession, sf: str) -> DataFrame:
    """The grid in four tiles that overlap by two rows and columns, put together again."""
    folder = caches.shared_folder(spark, "tiles")
    px = _pixels(spark, sf, folder)
    for i, (r0, r1) in enumerate(((0, 26), (24, ROWS))):
        for j, (c0, c1) in enumerate(((0, 11), (9, COLS))):
            geo = [GEO[0] + c0 * GEO[1], *GEO[1:3], GEO[3] + r0 * GEO[5], *GEO[4:]]
            own = D.window(px, r0, c0, r1 - r0, c1 - c0).select(F.lit(f"{folder}/{i}{j}.tif").alias("path"), (F.col("row") - r0).alias("row"), (F.col("col") - c0).alias("col"), "band", "value")
            rasters.write_files(rasters.encode_stacks(own, ["path"], ["B2", "B8"], r1 - r0, c1 - c0, geo, -9999.0)).collect()
    local = lambda df: df.withColumn("path", F.regexp_replace("path", "^file:", ""))
    return _values(rasters.mosaic(local(rasters.read_pixels(spark, folder)), local(rasters.read_headers(spark, folder))))


@query("d5_band_times", "WITH o AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders), n AS (SELECT m, row_number() OVER (ORDER BY m) AS i FROM o) SELECT CAST(i AS INTEGER) AS band_idx, strftime(m, '%Y%m%dT%H%M%S') AS ts, epoch(m) AS t_sec, (epoch(m) - min(epoch(m)) OVER ()) / 86400 AS days FROM n UNION ALL SELECT CAST(count(*) + 1 AS INTEGER), '', NULL, NULL FROM n")
def band_times(spark: SparkSession, sf: str) -> DataFrame:
    """Times from the descriptions of a raster's bands, a band for each month of orders and one without a time."""
    months = table(spark, sf, "orders").select(F.date_format(F.trunc("o_orderdate", "month"), "yyyyMMdd'T'HHmmss").alias("m")).distinct().orderBy("m").collect()  # a row per month
    names = [f"{r.m}_T48RVV_B2" for r in months] + ["plain"]
    folder = caches.shared_folder(spark, "times")
    px = spark.createDataFrame([(f"{folder}/t.tif", 0, 0, n, 1.0) for n in names], "path string, row int, col int, band string, value float")
    rasters.write_files(rasters.encode_stacks(px, ["path"], names, 1, 1, GEO)).collect()
    t = rasters.with_times(rasters.read_pixels(spark, folder))
    return D.relative_days(t, ["path"], "t_sec").select("band_idx", "ts", "t_sec", "days")


PLANES = """c AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'B2' ELSE 'B11' END AS band, strftime(date_trunc('month', o_orderdate), '%Y%m%dT%H%M%S') AS ts, o_custkey % 6 AS r, o_orderkey % 5 AS c, CAST(sum(o_orderkey % 100) AS DOUBLE) AS value FROM orders GROUP BY ALL),
p AS (SELECT DISTINCT band, ts FROM c)"""


@query("s11_scene_cache", f"WITH {PLANES} SELECT band, ts, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, value FROM p CROSS JOIN generate_series(0, 5) y(r) CROSS JOIN generate_series(0, 4) x(c) LEFT JOIN c USING (band, ts, r, c)")
def scene_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as planes of two bands and all months, written as a cube by every task and read by blocks of planes."""
    band = F.when(F.col("o_orderkey") % 2 == 0, "B2").otherwise("B11").alias("band")
    ts = F.date_format(F.trunc("o_orderdate", "month"), "yyyyMMdd'T'HHmmss").alias("ts")
    cells = table(spark, sf, "orders").groupBy(band, ts, (F.col("o_custkey") % 6).cast("int").alias("row"), (F.col("o_orderkey") % 5).cast("int").alias("col")).agg(F.sum(F.col("o_orderkey") % 100).cast("float").alias("value"))
    path = caches.shared_folder(spark, "scene")
    caches.write_planes(cells, path, "orders", 1.0, 2.0, 6, 5, GEO)
    caches.register(spark)
    return spark.read.format("scene_cache").option("path", path).load().select("band", "ts", "row", "col", F.col("value").cast("double").alias("value"))


@query("s14_sample_cache", "WITH s AS (SELECT l_suppkey AS k, month(l_shipdate) - 1 AS m, count(*) AS n, sum(l_linenumber) AS v FROM lineitem WHERE l_discount > 0.06 GROUP BY 1, 2), a AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i FROM s GROUP BY k) SELECT CAST(i AS BIGINT) AS sample_idx, CAST(m AS INTEGER) AS month, m * 86400.0 AS t, CAST(n AS DOUBLE) AS y0, CAST(CASE WHEN v % 3 > 0 THEN v END AS DOUBLE) AS y1, n IS NOT NULL AND v % 3 > 0 AS mask FROM a CROSS JOIN generate_series(0, 11) g(m) LEFT JOIN s USING (k, m)")
def sample_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as samples of twelve months and two bands, written by every task at its samples' places, and read back."""
    li = table(spark, sf, "lineitem").filter("l_discount > 0.06").groupBy("l_suppkey", (F.month("l_shipdate") - 1).alias("m")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("l_linenumber").cast("double").alias("v"))
    by_month = li.groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("m", F.array(F.col("n"), F.when(F.col("v") % 3 > 0, F.col("v")))))).alias("at"))
    y = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.coalesce(F.try_element_at("at", i), F.array(F.lit(None).cast("double"), F.lit(None).cast("double"))))
    samples = numbered(by_month.select("l_suppkey", y.alias("y")), ["l_suppkey"], "sample_idx").select("sample_idx", F.lit(0).cast("long").alias("scene_id"), F.lit(1).alias("row"), F.lit(2).alias("col"), "y")
    path = os.path.join(caches.shared_folder(spark, "samples"), "cache")
    caches.write_samples(samples, path, ["a", "b"], [{"scene_id": 0, "lon": 0.0, "lat": 0.0, "rows": 3, "cols": 3, "times": [86400.0 * m for m in range(12)]}], 2, 1, "lineitem")
    caches.register(spark)
    s = spark.read.format("sample_cache").option("path", path).load()
    each = s.select("sample_idx", F.posexplode(F.arrays_zip("t", "y", "mask")).alias("month", "z"))
    return each.select("sample_idx", "month", F.col("z.t").alias("t"), F.col("z.y")[0].cast("double").alias("y0"), F.col("z.y")[1].cast("double").alias("y1"), F.coalesce(F.col("z.mask"), F.lit(False)).alias("mask"))


@query("s15_archives", "SELECT 'r' || n_regionkey AS name, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS i, n_nationkey * 1.5::DOUBLE AS y, n_regionkey + 0.5::DOUBLE AS target FROM nation")
def archives(spark: SparkSession, sf: str) -> DataFrame:
    """A single-pixel archive for each region."""
    folder = caches.shared_folder(spark, "npz")
    for r in table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("keys")).collect():  # five regions
        np.savez(f"{folder}/r{r.n_regionkey}.npz", timestamps_days=np.arange(len(r["keys"]), dtype=float), observations=np.array(r["keys"]) * 1.5, target_time_day=np.float64(r.n_regionkey + 0.5))
    s = caches.read_npz(spark, folder)
    each = s.select(F.regexp_extract("path", r"([^/]+)\.npz$", 1).alias("name"), F.posexplode("y").alias("i", "v"), "target")
    return each.select("name", "i", F.col("v")[0].alias("y"), "target")


@query("s18_materialised", "SELECT step, CAST(n AS BIGINT) AS n FROM (SELECT 'first' AS step, count(*) AS n FROM nation UNION ALL SELECT 'same', count(*) FROM nation UNION ALL SELECT 'changed', count(*) FROM region)")
def materialised(spark: SparkSession, sf: str) -> DataFrame:
    """A kept table is read again while its sources' fingerprint stays, and made anew when that changes."""
    path = os.path.join(caches.shared_folder(spark, "kept"), "t")
    nation, region = table(spark, sf, "nation").select(F.col("n_name").alias("name")), table(spark, sf, "region").select(F.col("r_name").alias("name"))
    counts = [(step, caches.materialise(df, path, mark).count()) for step, df, mark in (("first", nation, "a"), ("same", region, "a"), ("changed", region, "b"))]
    return spark.createDataFrame(counts, "step string, n long")


@query("s20_csv", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def csv(spark: SparkSession, sf: str) -> DataFrame:
    path = os.path.join(caches.shared_folder(spark, "csv"), "t")
    tables.write_csv(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), path)
    return tables.read_csv(spark, path, "c_custkey long, c_nationkey long, c_acctbal double")


@query("w6_kept_targets", "SELECT r_name, '2020010' || r_regionkey || 'T000000' AS kept, CAST(NULL AS VARCHAR) AS other FROM region")
def kept_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Target times kept by scene and by the rule that chose them: the last one stored counts, another rule has none."""
    path = os.path.join(caches.shared_folder(spark, "targets"), "t")
    rows = []
    for r in table(spark, sf, "region").collect():  # five rows
        key = "min_valid_ratio=0.900000;late_fraction=0.250000"
        tables.keep_target(spark, path, r.r_name, key, "20190101T000000")
        tables.keep_target(spark, path, r.r_name, key, f"2020010{r.r_regionkey}T000000")
        rows.append((r.r_name, tables.kept_target(spark, path, r.r_name, key), tables.kept_target(spark, path, r.r_name, "another rule")))
    return spark.createDataFrame(rows, "r_name string, kept string, other string")


@query("r3_evaluation_draws", f"WITH RECURSIVE g(i, s) AS (SELECT CAST(0 AS BIGINT), (CAST(20260609 AS HUGEINT) * {sampling.MULTIPLIER} + {sampling.INCREMENT}) % 18446744073709551616 UNION ALL SELECT i + 1, (s * {sampling.MULTIPLIER} + {sampling.INCREMENT}) % 18446744073709551616 FROM g WHERE i < 1999) SELECT a.i // 2 AS draw, CAST(a.s % (SELECT count(*) FROM supplier) AS BIGINT) AS value, CAST(b.s AS VARCHAR) AS seed FROM g a JOIN g b ON a.i % 2 = 0 AND b.i = a.i + 1")
def evaluation_draws(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.draws(spark, 1000, 20260609, table(spark, sf, "supplier").count(), 2)


@query("o3_shared_target", TARGET.format(rated=RATED.replace("FROM events GROUP BY 1, 2)", "FROM events WHERE CAST(ts AS DATE) IN (SELECT d FROM (SELECT DISTINCT CAST(ts AS DATE) AS d, event_type FROM events) GROUP BY d HAVING count(*) = (SELECT count(DISTINCT event_type) FROM events)) GROUP BY 1, 2)"), limit=700000000, late=0.25))
def shared_target(spark: SparkSession, sf: str) -> DataFrame:
    """The target among the days that every band has."""
    e = D.align(D.mask_values(readings(spark, sf).withColumn("day", F.to_date("ts")), "value", 5, 100), "day", "event_type")
    return D.select_target(D.completeness(e, "day", "event_type", "value"), "day", "event_type", 0.7, 0.25)


@query("w15_differences", f"WITH {CELLS} SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, CAST(s - n AS DOUBLE) AS value FROM g")
def differences(spark: SparkSession, sf: str) -> DataFrame:
    """Signed differences of two bands that were written and read."""
    px = rasters.read_pixels(spark, _raster(spark, sf)).filter("value IS NOT NULL")
    one = lambda i, name: px.filter(F.col("band_idx") == i).select("row", "col", F.col("value").cast("double").alias(name))
    return rounded(tables.difference(one(2, "pred"), one(1, "truth"), ["row", "col"]).select("row", "col", "value"))
