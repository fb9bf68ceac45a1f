"""The commands, run whole; what they write is read back."""

import csv
import glob
import json
import math
import os

import numpy as np
import pytest

from chronopix import cli
from chronopix.functions import columns as C
from chronopix.sources import caches, tiff

GEO = [10.0, 0.5, 0.0, 50.0, 0.0, -0.5]
STAMPS = [f"{y}{m:02d}{d:02d}T000000" for y in (2019, 2020) for m in range(1, 13) for d in (1, 11, 21)]


def scene(path, rows=9, cols=8, seed=0):
    """Six bands, a season and a little noise; a missing plane and a value outside the valid range."""
    rng = np.random.default_rng(seed)
    season = 2000 + 500 * np.sin(2 * np.pi * np.arange(len(STAMPS)) / 36)
    data = {b: (season[:, None, None] * (1 + 0.1 * k) + rng.normal(size=(len(STAMPS), rows, cols))).astype(np.float32) for k, b in enumerate(C.BANDS)}
    data["B2"][3] = np.nan
    data["B3"][5, 1, 1] = 20_000
    caches.write_scene_cache(path, data, dict.fromkeys(data, STAMPS), "src", 1.0, 2.0, GEO)
    return data


@pytest.fixture(scope="module")
def world(tmp_path_factory):
    root = tmp_path_factory.mktemp("world")
    return str(root), scene(f"{root}/scene")


def raster(path):
    with open(path, "rb") as f:
        return tiff.Raster(f.read())


def test_full_scene_writes_rasters_and_merges_summaries(spark, world, tmp_path):
    root, data = world
    with open(tmp_path / "hants.json", "w") as f:
        json.dump({"hants": {"nof": 3, "sf": "none", "fet": 1e9}}, f)
    run = lambda method: cli.main(["full-scene", f"{root}/scene", "--methods", method, "--configs", f"hants={tmp_path}/hants.json", "--output", str(tmp_path / "out")])
    assert run("hants") == 0 and run("zhu2015") == 0
    (path,) = glob.glob(f"{tmp_path}/out/run_summaries/*.json")
    with open(path) as f:
        summary = json.load(f)
    assert summary["methods_run"] == ["hants", "zhu2015"] and summary["methods_updated"] == ["zhu2015"] and set(summary["prediction_outputs"]) == {"hants", "zhu2015"}
    truth = raster(summary["ground_truth_output"])
    ts = summary["target_time"]
    assert os.path.basename(summary["ground_truth_output"]) == f"[ground_truth]_src_lon1.000000_lat2.000000_{ts}.tif"
    assert truth.descriptions == list(C.BANDS) and truth.geo_transform == GEO and truth.nodata == -9999
    want = np.stack([data[b][STAMPS.index(ts)] for b in C.BANDS])
    assert np.allclose(truth.read(), want, atol=1e-2)
    pred = raster(summary["prediction_outputs"]["hants"]).read()
    assert np.abs(pred - want).max() < 100
    errors = pred - truth.read()
    assert summary["metrics"]["hants"]["all"]["rmse"] == pytest.approx(math.sqrt((errors.astype(float) ** 2).mean()), rel=1e-4)
    assert summary["metrics"]["hants"]["bands"]["B8"]["n"] == 72


def test_window_around_a_place(spark, world, tmp_path):
    root, data = world
    cli.main(["full-scene", f"{root}/scene", "--methods", "hants", "--window-size", "3", "--window-lon", "11.6", "--window-lat", "48.2", "--output", str(tmp_path / "out")])
    (path,) = glob.glob(f"{tmp_path}/out/**/*ground_truth*.tif", recursive=True)
    r = raster(path)
    with open(glob.glob(f"{tmp_path}/out/run_summaries/*.json")[0]) as f:
        ts = json.load(f)["target_time"]
    assert r.shape == (3, 3) and r.geo_transform == [11.0, 0.5, 0.0, 49.0, 0.0, -0.5]
    assert np.allclose(r.read()[3], data["B8"][STAMPS.index(ts), 2:5, 2:5], atol=1e-2)


def test_batch_goes_on_and_reports_errors(spark, world, tmp_path, capsys):
    root, _ = world
    os.makedirs(tmp_path / "broken")
    args = ["batch-full-scene", str(tmp_path / "broken"), f"{root}/scene", "--methods", "hants", "--output", str(tmp_path / "out")]
    cli.main([*args, "--continue-on-error"])
    with open(tmp_path / "out" / "batch_summary.json") as f:
        batch = json.load(f)
    assert (batch["attempted"], batch["failed"]) == (2, 1) and "meta.json" in batch["scenes"][0]["error"] and "broken" in capsys.readouterr().err
    with pytest.raises(FileNotFoundError):
        cli.main(args)


def test_ground_truth_of_a_time(spark, world, tmp_path):
    root, data = world
    cli.main(["ground-truth", f"{root}/scene", "--time", STAMPS[5], "--output", str(tmp_path / "t.tif")])
    assert np.allclose(raster(tmp_path / "t.tif").read()[1], data["B3"][5], atol=1e-2)
    with pytest.raises(ValueError, match="no time"):
        cli.ground_truth(spark, f"{root}/scene", "19990101T000000", str(tmp_path / "x.tif"))


def test_rasters_to_cache_and_back(spark, tmp_path):
    rng = np.random.default_rng(1)
    os.makedirs(tmp_path / "in")
    cubes = {b: rng.integers(1, 9999, (3, 4, 5)).astype(np.float32) for b in ("B2", "B11")}
    for b, x in cubes.items():
        with open(tmp_path / "in" / f"COPERNICUS_S2_HARMONIZED_{b}_lon1.0_lat2.0.tif", "wb") as f:
            f.write(tiff.encode(x, GEO, [f"{s}_{b}" for s in STAMPS[:3]], -9999.0))
    cli.main(["build-scene-cache", str(tmp_path / "in"), "--output", str(tmp_path / "cache"), "--source", "s"])
    meta = caches.scene_meta(str(tmp_path / "cache"))
    assert meta["bands"] == ["B2", "B11"] and meta["geo_transform"] == GEO
    got = spark.read.format("scene_cache").option("path", str(tmp_path / "cache")).load().filter(f"band = 'B11' AND ts = '{STAMPS[2]}'").orderBy("row", "col").collect()
    assert np.allclose([r.value for r in got], cubes["B11"][2].ravel())


def test_samples_evaluation_curves_and_bench(spark, world, tmp_path, capsys):
    root, data = world
    out = str(tmp_path / "samples")
    cli.main(["build-sample-cache", f"{root}/scene", "--output", out, "--n-samples", "40"])
    with open(f"{out}/meta.json") as f:
        assert json.load(f)["scenes"][0]["n_sampled"] == 40
    one = cli.samples(spark, out).filter("sample_idx = 7").first()
    assert np.allclose(np.array(one.y, dtype=float)[:, 3], data["B8"][:, one.row, one.col])
    capsys.readouterr()
    cli.main(["eval-sample-cache", out, "--method", "zhu2015", "--n-eval", "30", "--output", str(tmp_path / "eval")])
    summary = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (summary["attempted"], summary["evaluated"]) == (30, 30) and {r["index"] for r in summary["index_metrics"]} == set(C.INDICES)
    assert {r["band"] for r in summary["metrics"]} == {*C.BANDS, None}
    for name in ("gap_regular", "gap_periodic", "predictions"):
        (path,) = glob.glob(f"{tmp_path}/eval/{name}/*.csv")
        with open(path) as f:
            rows = list(csv.DictReader(f))
        assert rows and ("rmse" in rows[0] or "pred_5" in rows[0])
    assert sum(int(r["n"]) for r in csv.DictReader(open(glob.glob(f"{tmp_path}/eval/gap_periodic/*.csv")[0])) if not r["band"]) == 180
    cli.main(["sample-pixel-curve", out, "--sample", "7", "--output", str(tmp_path / "curve")])
    with open(glob.glob(f"{tmp_path}/curve/*.csv")[0]) as f:
        rows = list(csv.DictReader(f))
    assert len(rows[0]) == 19
    kinds = {k: [r for r in rows if r["kind"] == k] for k in ("observed", "target", "curve")}
    assert len(kinds["observed"]) == 72 * 6 and len(kinds["target"]) == 6 and len(kinds["curve"]) == 240 * 6
    assert all(abs(float(r[m]) - float(r["observed"])) < 400 for r in kinds["target"] for m in ("hants", "zhu2015"))
    assert all(r["vector"] and r["scene_lon"] == "1.0" for r in kinds["curve"])
    capsys.readouterr()
    cli.main(["pixel-bench", out, "--n-eval", "10"])
    bench = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert bench["fits"] == 10 and bench["spectrum_seconds"] > 0 and bench["fit_seconds"] > bench["spectrum_seconds"] / 10 and bench["rmse"] < 1500


def test_reports_over_pairs_of_rasters(spark, tmp_path):
    rng = np.random.default_rng(4)
    os.makedirs(tmp_path / "in")
    truth = rng.integers(200, 9000, (6, 5, 4)).astype(np.float32)
    pred = truth + rng.normal(0, 300, truth.shape).astype(np.float32)
    pred[2, 0, 0] = -9999
    write = lambda name, x, bands: open(tmp_path / "in" / name, "wb").write(tiff.encode(x, GEO, bands, -9999.0))
    write("[hants]_a_prediction.tif", pred, list(C.BANDS))
    write("[ground_truth]_a.tif", truth, [""] * 6)
    write("[hants]_b_prediction.tif", pred, list(C.BANDS))
    write("[hants]_s_lon1.500000_lat-2.250000_t_prediction.tif", pred, list(C.BANDS))
    write("[ground_truth]_s_lon1.500000_lat-2.250000_t.tif", truth, list(C.BANDS))
    with open(tmp_path / "sites.csv", "w") as f:
        f.write("id,lon,lat\nx,1.5,-2.25\ny,7,8\n")
    cli.main(["evaluate-rasters", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--rasters", "--sites", str(tmp_path / "sites.csv")])
    assert {r["site"] for r in csv.DictReader(open(glob.glob(f"{tmp_path}/out/sites/*.csv")[0]))} == {"x"}
    with open(tmp_path / "out" / "skipped_site_ids.txt") as f:
        assert f.read() == "y\n"
    with open(tmp_path / "out" / "skipped_sites.txt") as f:
        assert f.read() == "b\n"
    with open(glob.glob(f"{tmp_path}/out/evaluation_summary/*.csv")[0]) as f:
        rows = list(csv.DictReader(f))
    error = (pred - truth).astype(float)
    error[2, 0, 0] = np.nan
    rows = [r for r in rows if r["scene"] == "a"]
    one = next(r for r in rows if r["section"] == "continuous" and r["band_or_index"] == "B4")
    assert int(one["n"]) == 19 and float(one["rmse"]) == pytest.approx(math.sqrt(np.nanmean(error[2] ** 2))) and float(one["valid_ratio"]) == pytest.approx(0.95)
    assert float(one["p95"]) == pytest.approx(np.nanpercentile(error[2], 95))
    bins = [r for r in rows if r["section"] == "error_bin" and r["band_or_index"] == "B8"]
    assert sum(int(r["n"]) for r in bins) == 20 and len(bins) == 6
    ndvi = lambda x: (x[3] - x[2]) / (x[3] + x[2])
    d = ndvi(pred.astype(float)) - ndvi(truth.astype(float))
    d[0, 0] = np.nan
    site = {r["of"]: r for r in csv.DictReader(open(glob.glob(f"{tmp_path}/out/site_metrics/*.csv")[0])) if r["scene"] == "a"}
    assert float(site["NDVI"]["mae"]) == pytest.approx(np.nanmean(np.abs(d)), rel=1e-5)
    assert float(site["reflectance"]["rmse"]) == pytest.approx(math.sqrt(np.nanmean((error / 1e4) ** 2)))
    diff = raster(f"{tmp_path}/out/rasters/DIFF_[hants]_a.tif").read()
    assert np.allclose(diff[0], error[0], atol=1e-2) and diff[2, 0, 0] == -9999
    assert raster(f"{tmp_path}/out/rasters/INDEX_DIFF_[hants]_a.tif").descriptions == [k.upper() for k in C.INDICES]
    assert np.allclose(raster(f"{tmp_path}/out/rasters/INDEX_[hants]_a.tif").read()[0][1:], ndvi(pred.astype(float))[1:], atol=1e-5)
    classes = [r for r in rows if r["section"] == "confusion" and r["band_or_index"] == "NDVI"]
    assert len(classes) == 25 and sum(int(r["n"]) for r in classes) == 19
