import numpy as np
import pytest

from chronopix import cli
from chronopix.config import Algorithm
from chronopix.sources import caches, rasters, tables, tiff


def cube(bands=3, rows=7, cols=9):
    b, r, c = np.indices((bands, rows, cols))
    return ((r * cols + c) + 100 * b) * 0.1


@pytest.mark.parametrize(("tile", "deflate"), [(None, True), (None, False), (16, True), (4, True)])
def test_tiff_round_trip(tile, deflate):
    geo = [100.0, 0.5, 0.0, 50.0, 0.0, -0.5]
    x = cube()
    r = tiff.Raster(tiff.encode(x, geo, ["20200101T000000_B2", "a<b", ""], -9999.0, "WGS 84|", tile, deflate))
    assert r.shape == (7, 9) and r.bands == 3 and r.geo_transform == geo and r.nodata == -9999 and r.crs == "WGS 84|"
    assert r.descriptions == ["20200101T000000_B2", "a<b", ""]
    assert np.allclose(r.read(), x, atol=1e-5)
    assert np.allclose(r.read(2, 2, 3, 3, 3)[0], x[1, 2:5, 3:6], atol=1e-5)
    assert r.read(1, 5, 7, 99, 99).shape == (1, 2, 2)
    with pytest.raises(tiff.TiffError):
        r.read(4)
    with pytest.raises(tiff.TiffError):
        r.read(1, 7, 0, 1, 1)


def test_rotated_transform_and_damage():
    geo = [1.0, 0.5, 0.1, 2.0, 0.2, -0.5]
    assert tiff.Raster(tiff.encode(cube(1), geo)).geo_transform == geo
    with pytest.raises(tiff.TiffError):
        tiff.Raster(b"nothing")


def test_pixels_of_files(spark, tmp_path):
    x = cube(2)
    x[0, 0, 0] = -9999
    (tmp_path / "COPERNICUS_S2_HARMONIZED_B2_lon1.0000_lat2.0000.tif").write_bytes(tiff.encode(x, None, ["20200101T000000_x", ""], -9999.0))
    px = rasters.with_times(rasters.read_pixels(spark, str(tmp_path)))
    assert px.count() == 126 and px.filter("value IS NULL").count() == 1
    assert px.filter("band_idx = 1").first().t_sec == 1577836800 and px.filter("band_idx = 2").first().ts == ""
    assert rasters.read_pixels(spark, str(tmp_path), 2, (2, 3, 3, 3)).count() == 9
    head = rasters.read_headers(spark, str(tmp_path)).first()
    assert (head.rows, head.cols, head.n_bands) == (7, 9, 2)


def test_stacks_of_pixels(spark):
    rows = [("s", r, c, b, float(10 * r + c + i)) for i, b in enumerate(("B2", "B3")) for r in range(2) for c in range(3)]
    df = spark.createDataFrame(rows, "scene string, row int, col int, band string, value float")
    out = rasters.encode_stacks(df, ["scene"], ["B3", "B2"], 2, 3).first()
    r = tiff.Raster(bytes(out.content))
    assert r.descriptions == ["B3", "B2"] and r.read(1)[0].tolist() == [[1, 2, 3], [11, 12, 13]]
    with pytest.raises(ValueError):
        rasters.encode_stacks(df, ["scene"], [], 2, 3)


def scene(path, n=30, seed=0):
    rng = np.random.default_rng(seed)
    stamps = [f"2020{m:02d}{d:02d}T000000" for m in range(1, 13) for d in (1, 11, 21)][:n]
    season = 2000 + 500 * np.sin(2 * np.pi * np.arange(n) / 36)
    data = {b: (season[:, None, None] * k + rng.normal(size=(n, 4, 4))).astype(np.float32) for b, k in (("B2", 1.0), ("B3", 1.2))}
    data["B2"][3] = np.nan
    caches.write_scene_cache(path, data, {b: stamps for b in data}, "src", 1.0, 2.0, [0, 1, 0, 0, 0, -1])
    return data


def test_scene_cache(spark, tmp_path):
    path = str(tmp_path / "scene")
    data = scene(path)
    caches.register(spark)
    df = spark.read.format("scene_cache").option("path", path).option("planes", "7").load()
    assert df.count() == 960 and df.filter("value IS NULL").count() == 16
    got = df.filter("band = 'B3' AND ts = '20200111T000000' AND row = 2 AND col = 1").first().value
    assert got == pytest.approx(float(data["B3"][1, 2, 1]))
    assert caches.usable_scenes(spark, f"{path}/meta.json", "src").count() == 1
    with open(f"{path}/cube.f32.bin", "ab") as f:
        f.write(b"x")
    with pytest.raises(caches.CacheError):
        caches.scene_meta(path)


def test_full_scene_and_samples(spark, tmp_path):
    path = str(tmp_path / "scene")
    scene(path)
    ts, errors = cli.full_scene(spark, path, [Algorithm.HANTS], 0.9, 0.25, {})
    assert ts == "20201021T000000" and errors.count() == 32
    assert errors.filter("abs(error) > 400").count() == 0
    args = cli.parser().parse_args(["build-sample-cache", path, "--output", "x", "--n-samples", "10", "--min-joint-valid", "12"])
    s = cli.build_samples(spark, args).orderBy("sample_idx").collect()
    assert [r.sample_idx for r in s] == list(range(10)) and s[0].n_times == 30 and s[0].mask[3] is False


def test_sample_cache(spark, tmp_path):
    path = str(tmp_path / "samples")
    y = np.arange(8, dtype=float).reshape(4, 2)
    y[1, 0] = np.nan
    one = spark.createDataFrame([(0, 0, 1, 2, [[None if np.isnan(v) else float(v) for v in r] for r in y])], "sample_idx long, scene_id long, row int, col int, y array<array<double>>")
    caches.write_samples(one, path, ["B2", "B3"], [{"scene_id": 0, "lon": 0.0, "lat": 0.0, "rows": 3, "cols": 3, "times": [0.0, 86400, 172800, 259200]}], 2, 1, "src")
    caches.register(spark)
    r = spark.read.format("sample_cache").option("path", path).load().first()
    assert (r.scene_id, r.row, r.col, r.n_times) == (0, 1, 2, 4) and r.mask == [True, False, True, True] and r.y[1][0] is None
    assert cli.samples(spark, path).first().t == [0, 1, 2, 3]


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "a.npz", timestamps_days=np.arange(4.0), observations=np.array([1.0, np.nan, 2, 3]), target_time_day=np.float64(2.5))
    r = caches.read_npz(spark, str(tmp_path)).first()
    assert r.target == 2.5 and r.y == [[1.0], [None], [2.0], [3.0]]


def test_materialise_and_targets(spark, tmp_path):
    path = str(tmp_path / "t")
    assert caches.materialise(spark.range(3), path, "a").count() == 3
    assert caches.materialise(spark.range(5), path, "a").count() == 3
    assert caches.materialise(spark.range(5), path, "b").count() == 5
    kept = str(tmp_path / "targets")
    assert tables.kept_target(spark, kept, "s", "k") is None
    tables.keep_target(spark, kept, "s", "k", "20200101T000000")
    assert tables.kept_target(spark, kept, "s", "k") == "20200101T000000"


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, None)], "name string, x double, y int")
    assert tables.markdown(df).splitlines()[2] == "| a | 1.5 |  |"
    tables.write_csv(df, str(tmp_path / "c"), 1)
    assert tables.read_csv(spark, str(tmp_path / "c"), "name string, x double, y int").first().x == 1.5
    e = spark.createDataFrame([(1, "evaluated", 0.1, 0.2, 0, 1.0, 2.0), (1, "evaluated", 0.1, 0.2, 1, 3.0, 4.0)], "k int, status string, gap_regular double, gap_periodic double, band int, truth double, pred double")
    r = tables.prediction_rows(e, ["k"], [0, 1]).first()
    assert (r.truth_1, r.pred_0) == (3.0, 2.0)


def test_arguments():
    p = cli.parser()
    with pytest.raises(SystemExit):
        cli.input_mode(p.parse_args(["hants"]))
    with pytest.raises(SystemExit):
        cli.input_mode(p.parse_args(["hants", "--input-geotiff", "x.tif"]))
    assert cli.input_mode(p.parse_args(["hants", "--data", "x.npz"])) == "npz"
    assert cli.methods("hants, harmonic,hants") == [Algorithm.HANTS, Algorithm.HARMONIC]
    assert p.parse_args(["full-scene", "c", "--output", "o"]).min_valid_ratio == 0.9
