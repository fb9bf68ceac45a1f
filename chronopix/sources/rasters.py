"""Rasters as tables, and tables as rasters. Files are read through Spark, so any store that Spark reads will do."""

from __future__ import annotations

import mmap
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import columns as C
from . import tiff

HEADER = "path string, rows int, cols int, n_bands int, geo_transform array<double>, crs_wkt string, nodata double, descriptions array<string>"
PIXELS = "path string, band_idx int, description string, row int, col int, value float"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").option("recursiveFileLookup", "true").load(path).select("path", "content")


def exactly(path: str) -> str:
    """A path whose brackets and other signs of patterns stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """A row per file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"], strict=True):
                r = tiff.Raster(bytes(content))
                rows.append((p, *r.shape, r.bands, r.geo_transform, r.crs, r.nodata, r.descriptions))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in HEADER.split(", ")])

    return _files(spark, path).mapInPandas(run, HEADER)


def _plane(plane: np.ndarray, nodata: float | None) -> np.ndarray:
    """float32 with NaN for the file's no-data value."""
    return (np.where(plane == nodata, np.nan, plane) if nodata is not None else plane).astype(np.float32)


class GeoTiffSource(DataSource):
    """Format `geotiff`, for files that executors mount; options path (a file or a folder), band (from 1), window (row,col,rows,cols)
    and blocks (strips or tiles a partition, default 64). Only the blocks that the band and the window touch are read and inflated."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema):
        return _GeoTiffReader(self.options["path"], self.options.get("band"), self.options.get("window"), int(self.options.get("blocks", "64")))


class _Blocks(InputPartition):
    def __init__(self, *value):
        super().__init__(value)


class _GeoTiffReader(DataSourceReader):
    def __init__(self, path: str, band: str | None, window: str | None, blocks: int):
        self.paths = [path] if os.path.isfile(path) else sorted(os.path.join(d, f) for d, _, files in os.walk(path) for f in files if f.endswith(".tif"))
        self.band, self.blocks = int(band) if band else None, blocks
        self.window = tuple(int(x) for x in window.split(",")) if window else None

    def _bounds(self, r: tiff.Raster) -> tuple[int, int, int, int]:
        row, col, rows, cols = self.window or (0, 0, *r.shape)
        out = max(row, 0), max(col, 0), min(r.shape[0], row + rows), min(r.shape[1], col + cols)
        if out[0] >= out[2] or out[1] >= out[3]:
            raise tiff.TiffError("the window is empty")
        if self.band is not None and not 1 <= self.band <= r.bands:
            raise tiff.TiffError(f"there is no band {self.band}")
        return out

    def partitions(self):
        out = []
        for p in self.paths:
            with open(p, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
                r = tiff.Raster(data)
                at = r.touching(*self._bounds(r), self.band)
                out += [_Blocks(p, at[i : i + self.blocks]) for i in range(0, len(at), self.blocks)]
                del r
        return out

    def read(self, partition):
        import pyarrow as pa

        path, at = partition.value
        with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            r = tiff.Raster(data)
            row, col, end_row, end_col = self._bounds(r)
            names, places = r.descriptions, r.places()
            for k in at:
                b, r0, c0 = places[k]
                x = r.block(k)
                top, left = max(r0, row), max(c0, col)
                x = x[:, top - r0 : end_row - r0, left - c0 : end_col - c0]
                for i, plane in enumerate(x, b):
                    if self.band is not None and i != self.band - 1:
                        continue
                    cells = np.indices(plane.shape, dtype=np.int32).reshape(2, -1)
                    n = plane.size
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * n), pa.array(np.full(n, i + 1, dtype=np.int32)), pa.array([names[i]] * n), pa.array(cells[0] + np.int32(top)), pa.array(cells[1] + np.int32(left)), pa.array(_plane(plane, r.nodata).ravel(), pa.float32(), from_pandas=True)],
                        names=["path", "band_idx", "description", "row", "col", "value"],
                    )


def read_pixels(spark: SparkSession, path: str, band: int | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """A row per pixel and band of each file; window is (row, col, rows, cols), clamped. The file's no-data value and NaN become
    NULL. Files that the driver sees are read by blocks (GeoTiffSource); others, in stores that only Spark reads, as a whole each."""
    local = path.removeprefix("file://") if path.startswith(("/", "file:///")) else None
    if local and os.path.exists(local):
        spark.dataSource.register(GeoTiffSource)
        options = {"path": local} | ({"band": str(band)} if band else {}) | ({"window": ",".join(map(str, window))} if window else {})
        return spark.read.format("geotiff").options(**options).load()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                r = tiff.Raster(bytes(content))
                row, col, rows, cols = window or (0, 0, *r.shape)
                x = r.read(band, row, col, rows, cols)
                names = r.descriptions
                for k, plane in enumerate(x):
                    i = (band or k + 1) - 1
                    at = np.indices(plane.shape)
                    value = pd.array(_plane(plane, r.nodata).ravel(), dtype="Float32")
                    value[np.isnan(value.to_numpy(dtype=np.float32, na_value=np.nan))] = pd.NA
                    yield pd.DataFrame({"path": p, "band_idx": i + 1, "description": names[i], "row": at[0].ravel() + max(row, 0), "col": at[1].ravel() + max(col, 0), "value": value})

    return _files(spark, path).mapInPandas(run, PIXELS)


def mosaic(pixels: DataFrame, headers: DataFrame) -> DataFrame:
    """Pixels of tiles that share a grid, with rows and columns of the whole; of cells that several tiles hold, the first tile's by
    path that has a value."""
    heads = headers.select("path", F.col("geo_transform").alias("g"))
    first = heads.agg(F.min(F.col("g")[0]).alias("x0"), F.max(F.col("g")[3]).alias("y0"))
    offsets = heads.join(F.broadcast(first)).select("path", F.round((F.col("g")[3] - F.col("y0")) / F.col("g")[5]).cast("int").alias("_r"), F.round((F.col("g")[0] - F.col("x0")) / F.col("g")[1]).cast("int").alias("_c"))  # one row
    moved = pixels.join(offsets, "path").withColumn("row", F.col("row") + F.col("_r")).withColumn("col", F.col("col") + F.col("_c"))
    best = F.min_by("value", F.when(F.col("value").isNotNull(), F.col("path")))
    return moved.groupBy("band_idx", "description", "row", "col").agg(best.alias("value"))


def write_files(stacks: DataFrame) -> DataFrame:
    """Writes rows (path, content) as files, by the tasks that hold them, to a folder that executors mount: (path, bytes). A file gets its
    name when it is whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
                with open(path + ".tmp", "wb") as f:
                    f.write(bytes(content))
                os.replace(path + ".tmp", path)
            yield pd.DataFrame({"path": b["path"], "bytes": [len(c) for c in b["content"]]})

    return stacks.select("path", "content").mapInPandas(run, "path string, bytes long")


def with_times(pixels: DataFrame) -> DataFrame:
    """The timestamp text in a band's description ('' where there is none) and its epoch seconds."""
    text = F.coalesce(C.stamp("description"), F.lit(""))
    return pixels.withColumn("ts", text).withColumn("t_sec", C.epoch_seconds("ts"))


def encode_stacks(pixels: DataFrame, keys: list[str], bands: list[str], rows: int, cols: int, geo: list[float] | None = None, nodata: float = -9999.0) -> DataFrame:
    """Keys and content, a float32 GeoTIFF of the named bands in order; pixels has row, col, band, value.

    A scene's raster is one file, so its pixels meet in one task; scenes are independent.
    """
    if not bands:
        raise ValueError("a stack has at least one band")

    def make(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.full((len(bands), rows, cols), nodata, dtype=np.float32)
        at = {b: i for i, b in enumerate(bands)}
        frame = frame[frame["band"].isin(at)]
        x[frame["band"].map(at).to_numpy(dtype=int), frame["row"].to_numpy(), frame["col"].to_numpy()] = frame["value"].fillna(nodata)
        out = {k: [frame[k].iloc[0]] for k in keys}
        return pd.DataFrame({**out, "content": [tiff.encode(x, geo, bands, nodata)]})

    kinds = ", ".join(f"{k} {t}" for k, t in pixels.select(*keys).dtypes)
    return pixels.groupBy(*keys).applyInPandas(make, f"{kinds}, content binary")
