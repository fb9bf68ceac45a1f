"""Commands over the DataFrame API: python -m chronopix.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Algorithm, HantsConfig, HarmonicConfig, LassoConfig
from .functions import columns as C
from .operators import dataflow, evaluation, metrics, models, reports, sampling
from .session import session
from .sources import caches, rasters, tables

CONFIGS = {Algorithm.HARMONIC: HarmonicConfig, Algorithm.HANTS: HantsConfig, Algorithm.LASSO: LassoConfig}
NODATA = -9999.0


def methods(text: str) -> list[Algorithm]:
    """Comma-separated methods; none and unknown ones are errors."""
    out = [Algorithm.parse(x) for x in text.split(",") if x.strip()]
    if not out:
        raise argparse.ArgumentTypeError("name at least one method")
    return list(dict.fromkeys(out))


def config(which: Algorithm, path: str | None):
    """From a file, or the defaults; a file that can't be read is an error."""
    if not path:
        return CONFIGS[which]()
    with open(path, encoding="utf-8") as f:
        return CONFIGS[which].load(f.read())


def config_paths(text: str) -> dict[Algorithm, str]:
    """method=file, comma-separated."""
    return {Algorithm.parse(k): v for k, _, v in (x.partition("=") for x in text.split(",") if x.strip())}


def input_mode(args: argparse.Namespace) -> str:
    """An archive or a raster, not both; a raster needs an output."""
    if bool(args.data) == bool(args.input_geotiff):
        raise SystemExit("give either --data or --input-geotiff")
    if args.input_geotiff and not args.output:
        raise SystemExit("--input-geotiff needs --output")
    return "npz" if args.data else "geotiff"


def one_pixel_or_raster(spark: SparkSession, which: Algorithm, args: argparse.Namespace) -> DataFrame:
    """The three algorithm verbs. Rasters are taken as one band a day, whatever their descriptions say (D10); the result is a raster."""
    c = config(which, args.config)
    if input_mode(args) == "npz":
        s = caches.read_npz(spark, args.data)
        s = s.withColumn("target", F.lit(float(args.target_time))) if args.target_time is not None else s
        return models.predict(s, ["path"], which, c)
    px = rasters.read_pixels(spark, args.input_geotiff).withColumn("day", (F.col("band_idx") - 1).cast("double"))
    s = dataflow.to_series(px, ["path", "row", "col"], "day", ["value"]).withColumn("target", F.lit(float(args.target_time)) if args.target_time is not None else F.element_at("t", -1))
    at = ["path", "row", "col"]
    bands = ["prediction"]
    if which is Algorithm.LASSO:  # E10: with the quality of each pixel
        fit = models.fit_lasso(s, at, c)
        bands.append("qa")
        pred = fit.select(*at, F.lit("prediction").alias("band"), F.col("pred").cast("float").alias("value")).unionByName(fit.select(*at, F.lit("qa").alias("band"), F.col("qa").cast("float").alias("value")))
    else:
        pred = models.predict(s, at, which, c).select(*at, F.lit("prediction").alias("band"), F.element_at("pred", 1).cast("float").alias("value"))
    head = rasters.read_headers(spark, args.input_geotiff).first()
    return rasters.encode_stacks(pred, ["path"], bands, head.rows, head.cols, list(head.geo_transform))


@dataclass
class Scene:
    """What the steps of full-scene make: the target, the bands in order, and long tables (row, col, band, value)."""

    ts: str
    bands: list[str]
    meta: dict
    truth: DataFrame
    predictions: dict[Algorithm, DataFrame]

    def errors(self) -> DataFrame:
        out = None
        for m, p in self.predictions.items():
            e = metrics.prediction_errors(p.withColumnRenamed("value", "pred"), self.truth.withColumnRenamed("value", "truth"), ["row", "col", "band"]).withColumn("method", F.lit(m.value))
            out = e if out is None else out.unionByName(e)
        return out


def scene_observations(spark: SparkSession, cache: str, window: tuple[int, int, int, int] | None = None, work: str | None = None) -> DataFrame:
    """A scene cache as (row, col, ts, t_day, band, value): masked to valid reflectance, duplicates collapsed.

    With a work folder the cache is kept there as Parquet and read from it while its sources stay the same (S18).
    """
    caches.register(spark)
    raw = spark.read.format("scene_cache").option("path", cache).load()
    if work:
        meta = caches.scene_meta(cache)
        mark = meta.get("source_fingerprint") or f"{os.path.getmtime(os.path.join(cache, 'meta.json')):.0f}-{meta['total_values']}"
        raw = caches.materialise(raw, f"{work}/{safe_name(cache)}", mark, ("band",))
    if window:
        raw = dataflow.window(raw, *window)
    seen = dataflow.mask_values(raw, "value").withColumn("value", F.col("value").cast("double"))
    one = dataflow.collapse_duplicates(seen, ["row", "col", "ts", "band"], ["value"])
    return one.withColumn("t_day", C.epoch_seconds("ts") / 86400.0)


def safe_name(path: str) -> str:
    """A path as one safe name."""
    return "".join(c if c.isalnum() or c in "-_" else "_" for c in path.strip("/"))


def scene_window(meta: dict, size: int | None, lon: float | None, lat: float | None) -> tuple[int, int, int, int] | None:
    """(row, col, rows, cols) of a square around a place, or the centre; None for the whole scene."""
    if not size:
        return None
    row, col = dataflow.window_offset(meta["geo_transform"], (meta["rows"], meta["cols"]), size, lon, lat)
    return row, col, size, size


def reconstruct_scene(spark: SparkSession, cache: str, which: list[Algorithm], ratio: float, late: float, configs: dict, window: tuple[int, int, int, int] | None = None, work: str | None = None) -> Scene:
    """Target (kept in the work folder once chosen), hold-out, fit and prediction of every method."""
    obs = scene_observations(spark, cache, window, work)
    aligned = dataflow.align(obs, "ts", "band")
    key = C.target_key(ratio, late) + (f";window={window}" if window else "")
    ts = tables.kept_target(spark, f"{work}/targets", cache, key) if work else None
    if ts is None:
        step = 1 if window else 8
        scores = dataflow.completeness(dataflow.subsample(aligned, step), "ts", "band", "value")
        found = dataflow.select_target(scores, "ts", "band", ratio, late).first()
        if found is None:
            raise ValueError(f"{cache}: no time that all bands have")
        ts = found.ts
        if work:
            tables.keep_target(spark, f"{work}/targets", cache, key, ts)
    meta = caches.scene_meta(cache)
    bands = sorted(meta["bands"], key=lambda b: (int(b[1:].rstrip("A")) if b[1:].rstrip("A").isdigit() else 10_000, b))
    wide = dataflow.pivot_bands(aligned, ["row", "col", "ts", "t_day"], "band", "value", bands)
    train, truth = dataflow.hold_out(wide, "ts", spark.createDataFrame([(ts,)], "ts string"))
    at = spark.range(1).select((C.epoch_seconds(F.lit(ts)) / 86400.0).alias("t")).first().t
    s = dataflow.to_series(train, ["row", "col"], "t_day", bands).withColumn("target", F.lit(at))
    long = dataflow.unpivot_bands(truth.select("row", "col", *bands), ["row", "col"], bands)
    predictions = {}
    for m in which:
        named = F.explode(F.arrays_zip(F.array(*[F.lit(b) for b in bands]).alias("band"), F.col("pred").alias("value"))).alias("z")
        predictions[m] = models.predict(s, ["row", "col"], m, configs.get(m)).select("row", "col", named).select("row", "col", "z.*")
    return Scene(ts, bands, meta, long, predictions)


def full_scene(spark: SparkSession, cache: str, which: list[Algorithm], ratio: float, late: float, configs: dict) -> tuple[str, DataFrame]:
    """(target time, errors of every method, pixel and band)."""
    scene = reconstruct_scene(spark, cache, which, ratio, late, configs)
    return scene.ts, scene.errors()


def _stack(scene: Scene, values: DataFrame, path: str, window) -> DataFrame:
    row0, col0, rows, cols = window or (0, 0, scene.meta["rows"], scene.meta["cols"])
    geo = list(scene.meta["geo_transform"])
    geo[0], geo[3] = geo[0] + col0 * geo[1] + row0 * geo[2], geo[3] + col0 * geo[4] + row0 * geo[5]
    px = values.select(F.lit(path).alias("path"), (F.col("row") - row0).alias("row"), (F.col("col") - col0).alias("col"), "band", F.col("value").cast("float").alias("value"))
    return rasters.encode_stacks(px, ["path"], scene.bands, rows, cols, geo, NODATA)


def run_full_scene(spark: SparkSession, cache: str, args: argparse.Namespace) -> dict:
    """One scene: prediction and truth rasters, metrics, and a summary that keeps what earlier runs wrote for other methods."""
    began = time.time()
    meta = caches.scene_meta(cache)
    window = scene_window(meta, args.window_size, args.window_lon, args.window_lat)
    configs = {m: config(m, args.configs.get(m)) for m in args.methods}
    scene = reconstruct_scene(spark, cache, args.methods, args.min_valid_ratio, args.late_fraction, configs, window, f"{args.output}/work")
    source, lon, lat = meta["source_name"], meta["lon"], meta["lat"]
    name = lambda method, suffix: spark.range(1).select(C.stack_path(args.output, F.lit(method), source, F.lit(lon), F.lit(lat), F.lit(scene.ts), suffix)).first()[0]
    truth_path = name("ground_truth", "")
    outputs = {m.value: name(m.value, "_prediction") for m in args.methods}
    # predictions are written first, and errors are read from what was written
    rasters.write_files(_stack(scene, scene.truth, truth_path, window)).collect()
    for m, values in scene.predictions.items():
        rasters.write_files(_stack(scene, values, outputs[m.value], window)).collect()
    read = lambda path: rasters.read_pixels(spark, path).select("row", "col", F.col("description").alias("band"), F.col("value").cast("double").alias("value"))
    truth = read(truth_path).withColumnRenamed("value", "truth")
    found = {}
    for m in args.methods:
        e = metrics.prediction_errors(read(outputs[m.value]).withColumnRenamed("value", "pred"), truth, ["row", "col", "band"])
        rows = [r.asDict() for r in metrics.error_metrics(e, ["band"]).collect()]  # a row per band
        found[m.value] = {"bands": {r["band"]: r for r in rows if r["band"] is not None}, "all": next((r for r in rows if r["band"] is None), None)}
    folder = f"{args.output}/run_summaries"
    os.makedirs(folder, exist_ok=True)
    token = f"lon{lon:.6f}_lat{lat:.6f}"
    path = f"{folder}/reconstruction_summary_{source}_{token}_{scene.ts.replace(':', '-')}.json"
    before: dict = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            before = json.load(f)
    merged = before.get("metrics", {}) | found
    summary = {
        "source_name": source, "lon": lon, "lat": lat, "location_token": token, "target_time": scene.ts, "methods_run": sorted(merged), "methods_updated": [m.value for m in args.methods], "ordered_bands": scene.bands,
        "min_valid_ratio": args.min_valid_ratio, "late_fraction": args.late_fraction, "window_size": args.window_size, "window_lon": args.window_lon, "window_lat": args.window_lat, "scene_cache": cache,
        "prediction_outputs": before.get("prediction_outputs", {}) | outputs, "ground_truth_output": truth_path, "metrics": merged, "seconds": round(time.time() - began, 3),
    }
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump(summary, f, indent=1)
    os.replace(path + ".tmp", path)
    return {"scene_cache": cache, "status": "ok", "summary": path, "target_time": scene.ts}


def ground_truth(spark: SparkSession, cache: str, ts: str, path: str) -> None:
    """A cache's slice at one time as a raster, unmasked as it is kept; duplicates are averaged."""
    caches.register(spark)
    meta = caches.scene_meta(cache)
    raw = spark.read.format("scene_cache").option("path", cache).load().filter(F.col("ts") == ts)
    one = dataflow.collapse_duplicates(raw.withColumn("value", C.null_if_nan(F.col("value").cast("double"))), ["row", "col", "band"], ["value"])
    if not one.limit(1).count():
        raise ValueError(f"{cache} has no time {ts}")
    rasters.write_files(_stack(Scene(ts, meta["bands"], meta, one, {}), one, path, None)).collect()


def raster_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions and truths of a folder of stacks as (scene, method, row, col, band, pred, truth, error), matched by name."""
    px = rasters.read_pixels(spark, folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    p = C.prediction_name(name)
    stem = F.regexp_extract(name, r"^\[ground_truth\]_(.*)\.tif$", 1)
    # a band by its description, else by its place
    band = F.when(F.col("description").isin(*C.BANDS), F.col("description")).otherwise(F.get(F.array(*[F.lit(b) for b in C.BANDS]), F.col("band_idx") - 1))
    cells = px.withColumn("p", p).withColumn("stem", stem).withColumn("band", band)
    pred = cells.filter("p.method IS NOT NULL AND p.method <> 'ground_truth'").select(F.col("p.stem").alias("scene"), F.col("p.method").alias("method"), "row", "col", "band", "value")
    truth = cells.filter("stem <> ''").select(F.col("stem").alias("scene"), "row", "col", "band", "value")
    return reports.paired(pred, truth)


def evaluate_rasters(spark: SparkSession, args: argparse.Namespace) -> None:
    """Reports over pairs of rasters, and their difference and index rasters. Scenes without truth are listed."""
    pairs = raster_pairs(spark, args.folder)
    report, sites = reports.pair_report(pairs), reports.site_metrics(pairs)
    tables.write_csv(report, f"{args.output}/evaluation_summary", 1)
    tables.write_csv(sites, f"{args.output}/site_metrics", 1)
    with open(f"{args.output}/site_metrics.md", "w", encoding="utf-8") as f:
        f.write(tables.markdown(sites.orderBy("scene", "method", "of"), 100_000))
    heads = rasters.read_headers(spark, args.folder).withColumn("p", C.prediction_name(F.regexp_extract("path", r"([^/]+)$", 1)))
    if args.sites:
        place = lambda i: F.regexp_extract("scene", r"lon(-?\d+\.\d+)_lat(-?\d+\.\d+)", i).try_cast("double")
        at = [F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat")]
        known = tables.read_csv(spark, args.sites, tables.SITES).select(F.col("id").alias("site"), *at)
        named = sites.withColumn("lon", F.round(place(1), 4)).withColumn("lat", F.round(place(2), 4)).join(known, ["lon", "lat"])
        tables.write_csv(named, f"{args.output}/sites", 1)
        lost = dataflow.found_or_missing(known, named.select("site"), "site").filter("NOT found").orderBy("site").collect()  # a row per site
        with open(f"{args.output}/skipped_site_ids.txt", "w", encoding="utf-8") as f:
            f.writelines(f"{r.site}\n" for r in lost)
    predicted = heads.filter("p.method IS NOT NULL AND p.method <> 'ground_truth'").select(F.col("p.stem").alias("scene")).distinct()
    missing = dataflow.found_or_missing(predicted, pairs.select("scene"), "scene").filter("NOT found").orderBy("scene").collect()  # a row per scene
    with open(f"{args.output}/skipped_sites.txt", "w", encoding="utf-8") as f:
        f.writelines(f"{r.scene}\n" for r in missing)
    if args.rasters:
        shapes = heads.filter("p.method IS NOT NULL AND p.method <> 'ground_truth'").select(F.col("p.stem").alias("scene"), F.col("p.method").alias("method"), "rows", "cols", "geo_transform").collect()
        index = reports.indices(pairs).withColumnRenamed("index", "band")
        for r in shapes:  # a raster at a time: each is one file
            own = lambda df: df.filter((F.col("scene") == r.scene) & (F.col("method") == r.method))  # noqa: B023, E731
            names = [k.upper() for k in C.INDICES]
            for kind, df, bands, value in (("DIFF", pairs, list(C.BANDS), "error"), ("INDEX", index, names, "pred"), ("INDEX_DIFF", index, names, "error")):
                px = own(df).select(F.lit(f"{args.output}/rasters/{kind}_[{r.method}]_{r.scene}.tif").alias("path"), "row", "col", "band", F.col(value).cast("float").alias("value"))
                rasters.write_files(rasters.encode_stacks(px, ["path"], bands, r.rows, r.cols, list(r.geo_transform), NODATA)).collect()
        values = index.withColumn("index", F.col("band"))
        tables.write_csv(tables.index_manifest(values, ["scene", "method", "index"], "pred"), f"{args.output}/index_manifest", 1)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chronopix", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for a in Algorithm:
        s = sub.add_parser(a.value)
        for name in ("--data", "--input-geotiff", "--output", "--config"):
            s.add_argument(name)
        s.add_argument("--target-time", type=float)
    for name in ("full-scene", "batch-full-scene"):
        s = sub.add_parser(name)
        s.add_argument("caches", nargs="+")
        s.add_argument("--methods", type=methods, default=[Algorithm.HARMONIC])
        s.add_argument("--configs", type=config_paths, default={})
        s.add_argument("--min-valid-ratio", type=float, default=0.9)
        s.add_argument("--late-fraction", type=float, default=0.25)
        s.add_argument("--output", required=True)
        s.add_argument("--window-size", type=int)
        s.add_argument("--window-lon", type=float)
        s.add_argument("--window-lat", type=float)
        s.add_argument("--continue-on-error", action="store_true")
        s.add_argument("--limit", type=int)
    s = sub.add_parser("ground-truth")
    s.add_argument("cache")
    s.add_argument("--time", required=True)
    s.add_argument("--output", required=True)
    s = sub.add_parser("evaluate-rasters")
    s.add_argument("folder")
    s.add_argument("--output", required=True)
    s.add_argument("--rasters", action="store_true")
    s.add_argument("--sites", help="a CSV of id, lon, lat: scenes are named by their place, and sites without one are listed as skipped")
    s = sub.add_parser("build-scene-cache")
    s.add_argument("rasters")
    s.add_argument("--output", required=True)
    s.add_argument("--source", default="scene")
    s.add_argument("--lon", type=float, default=0.0)
    s.add_argument("--lat", type=float, default=0.0)
    s = sub.add_parser("build-sample-cache")
    s.add_argument("caches", nargs="+")
    s.add_argument("--output", required=True)
    s.add_argument("--n-samples", type=int, default=1_000_000)
    s.add_argument("--min-joint-valid", type=int, default=12)
    s.add_argument("--limit-scenes", type=int)
    s.add_argument("--source")
    s.add_argument("--seed", type=int, default=20260608)
    for name in ("eval-sample-cache", "sample-pixel-curve", "pixel-bench"):
        s = sub.add_parser(name)
        s.add_argument("cache")
        s.add_argument("--method", type=Algorithm.parse, default=Algorithm.HARMONIC)
        s.add_argument("--config")
        s.add_argument("--n-eval", type=int, default=10_000)
        s.add_argument("--seed", type=int, default=20260609)
        s.add_argument("--min-joint-valid", type=int, default=12)
        s.add_argument("--gap-bins", type=int, default=20)
        s.add_argument("--sample", type=int, default=0)
        s.add_argument("--repeats", type=int, default=1)
        s.add_argument("--output", required=name != "pixel-bench")
    return p


def samples(spark: SparkSession, cache: str) -> DataFrame:
    """A sample cache (or its Parquet form) as series: sample_idx, scene_id, row, col, t in days, y."""
    if cache.endswith(".parquet"):
        raw = spark.read.parquet(cache)
    else:
        caches.register(spark)
        raw = spark.read.format("sample_cache").option("path", cache).load()
    return raw.withColumn("t", F.transform("t", lambda x: x / 86400.0)).withColumn("y", F.col("y").cast("array<array<double>>"))


def sample_meta(cache: str) -> dict:
    path = os.path.join(cache, "meta.json")
    if not os.path.exists(path):
        return {"bands": list(C.BANDS), "scenes": []}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def evaluation_tasks(spark: SparkSession, s: DataFrame, n: int, seed: int) -> DataFrame:
    """N draws with replacement, each with the seed of its hold-out."""
    total = s.count()
    return sampling.draws(spark, min(n, total), seed, max(total, 1), per_draw=2).join(s, F.col("value") == F.col("sample_idx")).drop("value")


def evaluate_samples(spark: SparkSession, args: argparse.Namespace) -> dict:
    """V2: predictions, metrics by band and index, tallies and both gap curves; everything is read from the written predictions."""
    began = time.time()
    bands = sample_meta(args.cache)["bands"]
    tasks = evaluation_tasks(spark, samples(spark, args.cache), args.n_eval, args.seed)
    e = evaluation.holdout_errors(tasks, ["draw", "sample_idx"], args.method.value, config(args.method, args.config), args.min_joint_valid, seed="seed")
    e.write.mode("overwrite").parquet(f"{args.output}/predictions.parquet")
    seconds = time.time() - began
    e = spark.read.parquet(f"{args.output}/predictions.parquet")
    good = e.filter("status = 'evaluated'")
    wide = tables.prediction_rows(good, ["draw", "sample_idx"], list(range(len(bands))))
    tables.write_csv(wide, f"{args.output}/predictions", 1)
    for gap in ("gap_regular", "gap_periodic"):
        tables.write_csv(metrics.gap_curves(good, gap, args.gap_bins), f"{args.output}/{gap}", 1)
    at = {b: i for i, b in enumerate(bands)}
    by_index = []
    if set(C.BANDS) <= set(bands):
        both = [{b: F.col(f"{k}_{at[b]}") for b in C.BANDS} for k in ("pred", "truth")]
        by_index = [r.asDict() for r in metrics.index_errors(wide, *both, clamp=True).collect()]
    tallies = metrics.tallies(e.groupBy("draw").agg(F.first("status").alias("status")), "status").first().asDict()
    by_band = [r.asDict() | {"band": bands[r.band] if r.band is not None else None} for r in metrics.error_metrics(good, ["band"]).collect()]
    reasons = {r.reason: r.n for r in e.filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(20).collect()}
    summary = {"method": args.method.value, "cache": args.cache, "seed": args.seed, "seconds": seconds, **tallies, "metrics": by_band, "index_metrics": by_index, "reasons": reasons}
    with open(f"{args.output}/summary.json", "w", encoding="utf-8") as f:
        json.dump(summary, f, indent=1)
    return summary


def sample_curve(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The rows of one sample's curve file: what was observed, the date held out with each method's value for it, and the curves."""
    meta = sample_meta(args.cache)
    one = samples(spark, args.cache).filter(F.col("sample_idx") == args.sample)
    names = F.array(*[F.lit(b) for b in meta["bands"]])
    valid = F.filter(F.sequence(F.lit(0), F.size("y") - 1), lambda i: C.all_present(F.get("y", i)))
    one = one.withColumn("valid", valid).withColumn("valid_count", F.size("valid")).withColumn("target_index", F.try_element_at("valid", F.floor(F.size("valid") / 2).cast("int") + 1))
    train = one.withColumn("y", F.transform("y", lambda v, i: F.when(i == F.col("target_index"), F.transform(v, lambda _: F.lit(None).cast("double"))).otherwise(v)))
    keys = ["sample_idx", "scene_id", "row", "col", "n_times", "valid_count", "target_index"]
    dated = one.select(*keys, F.posexplode(F.arrays_zip("t", "y")).alias("time_index", "o"))
    observed = dated.select(*keys, "time_index", F.col("o.t").alias("time_day"), F.explode(F.arrays_zip(names.alias("band"), F.col("o.y").alias("observed"))).alias("z")).select(*keys, "time_index", "time_day", "z.*")
    curve = target = None
    for m in Algorithm:
        c = config(m, args.config if m is args.method else None)
        p = models.predict_curve(train, ["sample_idx"], m, c).select("sample_idx", F.col("i").alias("time_index"), F.col("t").alias("time_day"), F.explode(F.arrays_zip(names.alias("band"), F.col("pred").alias(_column(m)))).alias("z")).select("sample_idx", "time_index", "time_day", "z.*")
        curve = p if curve is None else curve.join(p.drop("time_day"), ["sample_idx", "time_index", "band"])
        at = train.withColumn("target", F.get("t", F.col("target_index"))).filter("target IS NOT NULL")
        q = models.predict(at, ["sample_idx"], m, c).select("sample_idx", F.explode(F.arrays_zip(names.alias("band"), F.col("pred").alias(_column(m)))).alias("z")).select("sample_idx", "z.*")
        target = q if target is None else target.join(q, ["sample_idx", "band"])
    target = observed.filter("time_index = target_index").join(target, ["sample_idx", "band"])
    curve = curve.join(one.select(*keys), "sample_idx")
    rows = tables.curve_rows(observed, target, curve)
    scenes = spark.createDataFrame([(s["scene_id"], float(s["lon"]), float(s["lat"])) for s in meta["scenes"]], "scene_id long, scene_lon double, scene_lat double")
    rows = rows.join(F.broadcast(scenes), "scene_id", "left")  # a row per scene
    rows = rows.withColumn("time_epoch", F.col("time_day") * 86400.0).withColumn("time_year", C.fractional_year(F.timestamp_seconds(F.col("time_day") * 86400.0)))
    columns = [x.split() for x in tables.CURVES.split(", ")]
    return rows.select(*[F.col(name).cast(kind).alias(name) for name, kind in columns]).orderBy("kind", "band", "time_index")


def _column(m: Algorithm) -> str:
    return "vector" if m is Algorithm.HARMONIC else m.value


def pixel_bench(spark: SparkSession, args: argparse.Namespace) -> dict:
    """V4: seconds of a spectrum and of a fit, fits a second of the whole job, and the RMSE of the held-out dates."""
    c = config(Algorithm.HARMONIC, args.config)
    tasks = evaluation_tasks(spark, samples(spark, args.cache), args.n_eval, args.seed)
    began = time.time()
    r = evaluation.timings(tasks, ["draw"], c, args.repeats, args.min_joint_valid).agg(F.count(F.lit(1)).alias("fits"), F.avg("spectrum_seconds").alias("spectrum"), F.avg("fit_seconds").alias("fit"), F.sqrt(F.avg("squared_error")).alias("rmse")).first()
    took = time.time() - began
    return {"fits": r.fits, "seconds": took, "fits_per_second": r.fits / took, "spectrum_seconds": r.spectrum, "fit_seconds": r.fit, "rmse": r.rmse}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session()
    if args.command in {a.value for a in Algorithm}:
        out = one_pixel_or_raster(spark, Algorithm(args.command), args)
        if args.input_geotiff:
            rasters.write_files(out.select(F.lit(args.output).alias("path"), "content")).collect()
        elif args.output:
            out.write.mode("overwrite").parquet(args.output)
        else:
            out.show(truncate=False)
    elif args.command in ("full-scene", "batch-full-scene"):
        done = []
        for cache in args.caches[: args.limit]:
            try:
                done.append(run_full_scene(spark, cache, args))
            except Exception as e:
                if not args.continue_on_error:
                    raise
                print(f"{cache}: {e}", file=sys.stderr)
                done.append({"scene_cache": cache, "status": "failed", "error": str(e)[:2000]})
        if args.command == "batch-full-scene":
            with open(f"{args.output}/batch_summary.json", "w", encoding="utf-8") as f:
                json.dump({"attempted": len(done), "failed": sum(d["status"] == "failed" for d in done), "scenes": done}, f, indent=1)
    elif args.command == "ground-truth":
        ground_truth(spark, args.cache, args.time, args.output)
    elif args.command == "evaluate-rasters":
        os.makedirs(args.output, exist_ok=True)
        evaluate_rasters(spark, args)
    elif args.command == "build-scene-cache":
        px = rasters.with_times(rasters.read_pixels(spark, args.rasters)).withColumn("band", C.band_file("path")["band"])
        head = rasters.read_headers(spark, args.rasters).first()
        caches.write_planes(px, args.output, args.source, args.lon, args.lat, head.rows, head.cols, list(head.geo_transform), head.crs_wkt, head.nodata)
    elif args.command == "build-sample-cache":
        s = build_samples(spark, args)
        if args.output.endswith(".parquet"):
            s.write.mode("overwrite").parquet(args.output)
        else:
            write_sample_cache(spark, s, args)
    elif args.command == "sample-pixel-curve":
        tables.write_csv(sample_curve(spark, args), args.output, 1)
    elif args.command == "pixel-bench":
        print(json.dumps(pixel_bench(spark, args)))
    else:
        print(json.dumps(evaluate_samples(spark, args)))
    return 0


def build_samples(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Eligible pixels of all scenes, a draw of them, and their series."""
    caches.register(spark)
    chosen_caches = usable(spark, args)
    raw = dataflow.merge_chunks([spark.read.format("scene_cache").option("path", c).load().withColumn("scene_id", F.lit(i).cast("long")) for i, c in enumerate(chosen_caches)])
    bands = caches.scene_meta(chosen_caches[0])["bands"]
    wide = dataflow.pivot_bands(raw.withColumn("t", C.epoch_seconds("ts")), ["scene_id", "row", "col", "t"], "band", "value", bands)
    el = dataflow.eligible(wide, ["scene_id", "row", "col"], bands, args.min_joint_valid)
    chosen = sampling.sample_pixels(el, "scene_id", ["row", "col"], args.n_samples, args.seed)
    s = dataflow.to_series(wide, ["scene_id", "row", "col"], "t", bands)
    out = chosen.join(s, ["scene_id", "row", "col"])
    mask = F.transform("y", lambda v: F.forall(v, lambda x: x.isNotNull()))
    return out.select("sample_idx", "scene_id", "row", "col", F.size("t").alias("n_times"), "t", F.col("y").cast("array<array<float>>").alias("y"), mask.alias("mask"))


def usable(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """The caches to draw from: with --source those of that source with the right layout and the same times in every band."""
    if not args.source:
        return args.caches[: args.limit_scenes]
    paths = [os.path.join(os.path.abspath(c), "meta.json") for c in args.caches]
    good = caches.usable_scenes(spark, paths, args.source).select(F.input_file_name().alias("path")).collect()  # a row per cache
    names = {r.path.removeprefix("file://") for r in good}
    out = [c for c, p in zip(args.caches, paths, strict=True) if p in names]
    if not out:
        raise SystemExit(f"no usable scene of {args.source}")
    return out[: args.limit_scenes]


def write_sample_cache(spark: SparkSession, s: DataFrame, args: argparse.Namespace) -> None:
    """The drawn samples as a sample cache; scenes' times are those that any band has."""
    scenes, source, bands = [], "", []
    for i, c in enumerate(usable(spark, args)):
        m = caches.scene_meta(c)
        source, bands = m["source_name"], m["bands"]
        stamps = sorted({t for b in m["band_meta"] for t in b["timestamps"]})
        seconds = spark.createDataFrame([(t,) for t in stamps], "ts string").select(C.epoch_seconds_or_raise("ts").alias("t")).distinct().orderBy("t").collect()
        scenes.append({"scene_id": i, "lon": m["lon"], "lat": m["lat"], "rows": m["rows"], "cols": m["cols"], "times": [r.t for r in seconds], "cache_dir": c})
    caches.write_samples(s, args.output, bands, scenes, args.min_joint_valid, args.seed, source)


if __name__ == "__main__":
    raise SystemExit(main())
