"""Scene caches, sample caches and single-pixel archives.

A scene cache is cube.f32.bin (band, time, row, col) with meta.json; a sample cache is samples.f32.bin, mask.u8.bin,
scene_times.f64.bin and index.u64.bin with meta.json. Both are read by Python data sources, a block of planes or samples a
partition, from a folder that all executors mount; read once, they are kept as Parquet.
"""

from __future__ import annotations

import io
import json
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Names, versions and layouts of the formats.
VERSION, DTYPE = 1, "f32_le"
SCENE_LAYOUT, SAMPLE_LAYOUT, MASK_LAYOUT, INDEX_LAYOUT = "band_time_row_col", "sample_time_band", "sample_time", "sample_scene_row_col_n_times"
SCENE_SCHEMA = "source_name string, lon double, lat double, band string, ts string, row int, col int, value float"
SAMPLE_SCHEMA = "sample_idx long, scene_id long, row int, col int, n_times int, t array<double>, y array<array<float>>, mask array<boolean>"


class CacheError(ValueError):
    pass


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, or where that is unset and one process does all, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors mount")
    path = os.path.join(root.removeprefix("file://"), f"chronopix-{name}-{uuid.uuid4().hex}") if root else tempfile.mkdtemp(prefix=f"chronopix-{name}-")
    os.makedirs(path, exist_ok=True)
    return path


def scene_meta(path: str) -> dict:
    """meta.json, checked against version, layout, type, sizes and the cube's length."""
    with open(os.path.join(path, "meta.json"), encoding="utf-8") as f:
        meta = json.load(f)
    if (meta["version"], meta["layout"], meta["dtype"]) != (VERSION, SCENE_LAYOUT, DTYPE):
        raise CacheError(f"{path}: version, layout or type differ")
    plane = meta["rows"] * meta["cols"]
    total = sum(b["time_len"] * plane for b in meta["band_meta"])
    if total != meta["total_values"] or os.path.getsize(os.path.join(path, "cube.f32.bin")) != 4 * total:
        raise CacheError(f"{path}: the cube has another size")
    if any(len(b["timestamps"]) != b["time_len"] for b in meta["band_meta"]):
        raise CacheError(f"{path}: a band's timestamps do not match its planes")
    return meta


def write_scene_cache(path: str, cubes: dict[str, np.ndarray], times: dict[str, list[str]], source: str, lon: float, lat: float, geo: list[float], crs: str | None = None, nodata: float | None = None, fingerprint: str | None = None) -> None:
    """W3 from arrays at hand, such as a fixture's; write_planes() is for tables. Writes beside and renames, so no reader meets half a
    cache."""
    os.makedirs(path, exist_ok=True)
    shape = next(iter(cubes.values())).shape[1:]
    band_meta, offset = [], 0
    with open(os.path.join(path, "cube.f32.bin.tmp"), "wb") as f:
        for band, cube in cubes.items():
            if cube.shape[1:] != shape or len(times[band]) != len(cube):
                raise CacheError(f"band {band} has another shape")
            f.write(np.ascontiguousarray(cube, dtype="<f4").tobytes())
            band_meta.append({"name": band, "timestamps": times[band], "time_len": len(cube), "offset_values": offset})
            offset += cube.size
    meta = {"version": VERSION, "source_name": source, "lon": lon, "lat": lat, "rows": shape[0], "cols": shape[1], "layout": SCENE_LAYOUT, "dtype": DTYPE, "bands": list(cubes), "band_meta": band_meta, "total_values": offset, "geo_transform": geo, "crs_wkt": crs, "nodata": nodata, "source_fingerprint": fingerprint}
    with open(os.path.join(path, "meta.json.tmp"), "w", encoding="utf-8") as f:
        json.dump(meta, f)
    for name in ("cube.f32.bin", "meta.json"):
        os.replace(os.path.join(path, name + ".tmp"), os.path.join(path, name))


def write_planes(pixels: DataFrame, path: str, source: str, lon: float, lat: float, rows: int, cols: int, geo: list[float], crs: str | None = None, nodata: float | None = None, fingerprint: str | None = None) -> None:
    """W3 from a table (band, ts, row, col, value): every task writes its planes at their places in the cube, which executors mount.

    Only the list of bands and times comes to the driver. The files get their names when all planes are written.
    """
    listed = pixels.select("band", "ts").distinct().collect()  # a row per plane
    bands = sorted({r.band for r in listed}, key=lambda b: (int(b[1:].rstrip("A")) if b[:1] == "B" and b[1:].rstrip("A").isdigit() else 10_000, b))
    times = {b: sorted(r.ts for r in listed if r.band == b) for b in bands}
    plane, offset, band_meta, at = rows * cols, 0, [], {}
    for b in bands:
        band_meta.append({"name": b, "timestamps": times[b], "time_len": len(times[b]), "offset_values": offset})
        at |= {(b, t): offset + i * plane for i, t in enumerate(times[b])}
        offset += len(times[b]) * plane
    os.makedirs(path, exist_ok=True)
    cube = os.path.join(path, "cube.f32.bin.tmp")
    with open(cube, "wb") as f:
        f.truncate(4 * offset)

    def write(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x = np.full((rows, cols), np.nan, dtype="<f4")
        x[frame["row"].to_numpy(), frame["col"].to_numpy()] = frame["value"].to_numpy(dtype=np.float64, na_value=np.nan)
        with open(cube, "r+b") as f:
            f.seek(4 * at[key])
            f.write(x.tobytes())
        return pd.DataFrame({"n": [int(np.isfinite(x).sum())]})

    pixels.select("band", "ts", "row", "col", "value").groupBy("band", "ts").applyInPandas(write, "n long").agg(F.sum("n")).collect()
    meta = {"version": VERSION, "source_name": source, "lon": lon, "lat": lat, "rows": rows, "cols": cols, "layout": SCENE_LAYOUT, "dtype": DTYPE, "bands": bands, "band_meta": band_meta, "total_values": offset, "geo_transform": geo, "crs_wkt": crs, "nodata": nodata, "source_fingerprint": fingerprint}
    with open(os.path.join(path, "meta.json.tmp"), "w", encoding="utf-8") as f:
        json.dump(meta, f)
    for name in ("cube.f32.bin", "meta.json"):
        os.replace(os.path.join(path, name + ".tmp"), os.path.join(path, name))


def write_samples(samples: DataFrame, path: str, bands: list[str], scenes: list[dict], least: int, seed: int, source: str) -> None:
    """W4 from a table (sample_idx, gapless from 0, scene_id, row, col, y): every task writes its samples at their places."""
    tmp = path.rstrip("/") + ".tmp"
    os.makedirs(tmp)
    widest = max((len(s["times"]) for s in scenes), default=0)
    per_scene = {r.scene_id: r.n for r in samples.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, listed, offset = sum(per_scene.values()), [], 0
    for s in scenes:
        listed.append({"scene_id": s["scene_id"], "source_name": source, "lon": s["lon"], "lat": s["lat"], "rows": s["rows"], "cols": s["cols"], "n_times": len(s["times"]), "time_offset": offset, "n_sampled": per_scene.get(s["scene_id"], 0), "cache_dir": s.get("cache_dir", "")})
        offset += len(s["times"])
    sizes = {"samples.f32.bin": 4 * widest * len(bands), "mask.u8.bin": widest, "index.u64.bin": 32}
    for name, each in sizes.items():
        with open(f"{tmp}/{name}", "wb") as f:
            f.truncate(each * total)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(f"{tmp}/samples.f32.bin", "r+b") as f, open(f"{tmp}/mask.u8.bin", "r+b") as g, open(f"{tmp}/index.u64.bin", "r+b") as h:
            for b in batches:
                for s in b.to_dict("records"):
                    y = np.full((widest, len(bands)), np.nan, dtype="<f4")
                    own = [[np.nan if v is None else v for v in row] for row in s["y"]]
                    y[: len(own)] = own
                    parts = (y, np.isfinite(y).all(1).astype("u1"), np.array([s["scene_id"], s["row"], s["col"], len(own)], dtype="<u8"))
                    for file, each, x in zip((f, g, h), sizes.values(), parts, strict=True):
                        file.seek(each * s["sample_idx"])
                        file.write(x.tobytes())
                yield pd.DataFrame({"n": [len(b)]})

    samples.select("sample_idx", "scene_id", "row", "col", "y").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    np.concatenate([np.asarray(s["times"], dtype="<f8") for s in scenes] or [np.empty(0)]).tofile(f"{tmp}/scene_times.f64.bin")
    meta = {"version": VERSION, "source_name": source, "dtype": DTYPE, "layout": SAMPLE_LAYOUT, "mask_layout": MASK_LAYOUT, "index_layout": INDEX_LAYOUT, "n_samples": total, "max_times": widest, "n_bands": len(bands), "bands": bands, "sample_file": "samples.f32.bin", "mask_file": "mask.u8.bin", "scene_time_file": "scene_times.f64.bin", "index_file": "index.u64.bin", "index_columns": ["scene_id", "row", "col", "n_times"], "min_joint_valid": least, "seed": seed, "scenes": listed}
    with open(f"{tmp}/meta.json", "w", encoding="utf-8") as f:
        json.dump(meta, f)
    os.replace(tmp, path)


class _Block(InputPartition):
    def __init__(self, *value):
        super().__init__(value)


class SceneCacheSource(DataSource):
    """Format `scene_cache`; options path (the cache's folder) and planes (per partition, default 16)."""

    @classmethod
    def name(cls) -> str:
        return "scene_cache"

    def schema(self) -> str:
        return SCENE_SCHEMA

    def reader(self, schema):
        return _SceneReader(self.options["path"], int(self.options.get("planes", "16")))


class _SceneReader(DataSourceReader):
    def __init__(self, path: str, planes: int):
        self.path, self.planes, self.meta = path, planes, scene_meta(path)

    def partitions(self):
        return [_Block(k, i, min(i + self.planes, b["time_len"])) for k, b in enumerate(self.meta["band_meta"]) for i in range(0, b["time_len"], self.planes)]

    def read(self, partition):
        import pyarrow as pa

        k, first, last = partition.value
        m, b = self.meta, self.meta["band_meta"][k]
        plane = m["rows"] * m["cols"]
        at = np.indices((m["rows"], m["cols"]), dtype=np.int32).reshape(2, -1)
        for i in range(first, last):
            x = np.fromfile(os.path.join(self.path, "cube.f32.bin"), dtype="<f4", count=plane, offset=4 * (b["offset_values"] + i * plane))
            same = lambda v, t: pa.array([v] * plane, t)
            yield pa.RecordBatch.from_arrays(
                [same(m["source_name"], pa.string()), same(m["lon"], pa.float64()), same(m["lat"], pa.float64()), same(b["name"], pa.string()), same(b["timestamps"][i], pa.string()), pa.array(at[0]), pa.array(at[1]), pa.array(x, pa.float32(), from_pandas=True)],
                names=["source_name", "lon", "lat", "band", "ts", "row", "col", "value"],
            )


class SampleCacheSource(DataSource):
    """Format `sample_cache`; options path and samples (per partition, default 4096)."""

    @classmethod
    def name(cls) -> str:
        return "sample_cache"

    def schema(self) -> str:
        return SAMPLE_SCHEMA

    def reader(self, schema):
        return _SampleReader(self.options["path"], int(self.options.get("samples", "4096")))


class _SampleReader(DataSourceReader):
    def __init__(self, path: str, block: int):
        self.path, self.block = path, block
        with open(os.path.join(path, "meta.json"), encoding="utf-8") as f:
            self.meta = m = json.load(f)
        if (m["version"], m["dtype"], m["layout"], m["mask_layout"], m["index_layout"]) != (VERSION, DTYPE, SAMPLE_LAYOUT, MASK_LAYOUT, INDEX_LAYOUT):
            raise CacheError(f"{path}: version, type or layout differ")
        sizes = {m["sample_file"]: 4 * m["max_times"] * m["n_bands"], m["mask_file"]: m["max_times"], m["index_file"]: 32}
        for name, each in sizes.items():
            if os.path.getsize(os.path.join(path, name)) != each * m["n_samples"]:
                raise CacheError(f"{name} has another size")

    def partitions(self):
        return [_Block(i, min(i + self.block, self.meta["n_samples"])) for i in range(0, self.meta["n_samples"], self.block)]

    def read(self, partition) -> Iterator[tuple]:
        m, (first, last) = self.meta, partition.value
        n, w, b = last - first, m["max_times"], m["n_bands"]
        part = lambda name, kind, each: np.fromfile(os.path.join(self.path, name), dtype=kind, count=n * each, offset=first * each * np.dtype(kind).itemsize)
        y = part(m["sample_file"], "<f4", w * b).reshape(n, w, b)
        mask = part(m["mask_file"], "u1", w).reshape(n, w)
        index = part(m["index_file"], "<u8", 4).reshape(n, 4)
        times = np.fromfile(os.path.join(self.path, m["scene_time_file"]), dtype="<f8")
        start = {s["scene_id"]: s["time_offset"] for s in m["scenes"]}
        for i in range(n):
            scene, row, col, k = (int(v) for v in index[i])
            own = times[start[scene] : start[scene] + k]
            yield first + i, scene, row, col, k, own.tolist(), [[None if np.isnan(v) else float(v) for v in r] for r in y[i, :k]], [bool(v) for v in mask[i, :k]]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SceneCacheSource)
    spark.dataSource.register(SampleCacheSource)


def usable_scenes(spark: SparkSession, pattern: str | list[str], source: str) -> DataFrame:
    """Metas of the source with the right version and layout and the same timestamps in every band."""
    m = spark.read.option("multiLine", "true").json(pattern)
    same = F.size(F.array_distinct(F.transform("band_meta", lambda b: b["timestamps"]))) == 1
    return m.filter((F.col("version") == VERSION) & (F.col("layout") == SCENE_LAYOUT) & (F.col("source_name") == source) & same)


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """Path, t, y, target of single-pixel archives; a wrong length raises."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"], strict=True):
                z = np.load(io.BytesIO(bytes(content)))
                t, y = z["timestamps_days"].astype(float), z["observations"].astype(float)
                if len(t) != len(y):
                    raise CacheError(f"{p}: {len(t)} times and {len(y)} observations")
                rows.append((p, t.tolist(), [[None if np.isnan(v) else float(v)] for v in y], float(z["target_time_day"])))
            yield pd.DataFrame(rows, columns=["path", "t", "y", "target"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, t array<double>, y array<array<double>>, target double")


def materialise(df: DataFrame, path: str, fingerprint: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The Parquet table at path, written anew unless it was made from the same sources."""
    spark = df.sparkSession
    mark = f"{path}/_fingerprint-{fingerprint}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(mark)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        fs.create(target).close()
    return spark.read.parquet(path)
