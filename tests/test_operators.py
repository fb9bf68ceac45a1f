import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopix.config import HantsConfig, HarmonicConfig
from chronopix.functions import columns as C
from chronopix.kernels import harmonic
from chronopix.operators import dataflow, evaluation, metrics, models, sampling, windows


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_timestamps(spark):
    assert one(spark, C.epoch_seconds(F.lit("20171221T035139"))) == 1513828299
    assert one(spark, C.epoch_seconds(F.lit("2026-01-01T00:00:00"))) == 1767225600
    assert one(spark, C.epoch_seconds(F.lit("2026-01-01"))) is None
    assert one(spark, C.stamp(F.lit("20151227T035152_20151227T035506_T48RVV_B2"))) == "20151227T035152"
    assert one(spark, C.stamp(F.lit("none"))) is None


def test_names(spark):
    p = one(spark, C.band_file(C.strip_chunk(F.lit("COPERNICUS_S2_HARMONIZED_B2_lon-62.2159_lat-3.4653-0000000000-0000001024"))))
    assert (p.band, p.lon, p.lat) == ("B2", -62.2159, -3.4653)
    assert one(spark, C.prediction_name(F.lit("[hants]_scene_1_prediction.tif"))).asDict() == {"method": "hants", "stem": "scene_1"}
    assert one(spark, C.location_token(F.lit(1.0), F.lit(-2.5))) == "lon1.0000_lat-2.5000"
    assert C.target_key(0.9, 0.25) == "min_valid_ratio=0.900000;late_fraction=0.250000"
    names = spark.createDataFrame([(b,) for b in ["B12", "B8A", "X", "B2", "B11", "B8", "B4", "B3"]], "b string")
    assert [r.b for r in dataflow.bands_in_order(names, "b").collect()] == ["B2", "B3", "B4", "B8", "B8A", "B11", "B12", "X"]


def test_valid_mask(spark):
    values = F.array(*[F.lit(v).cast("double") for v in (500, float("nan"), 0, 10000, 3000, -1)])
    assert one(spark, C.valid_mask(values)) == [True, False, False, False, True, False]


def test_bins(spark):
    labels = [one(spark, C.error_bin(F.lit(v))) for v in (0.0, 50.0, 50.1, -1000.0, 1001.0)]
    assert labels == ["<=50", "<=50", "50-100", "500-1000", ">1000"]
    assert [one(spark, C.index_class(F.lit(v))) for v in (-0.1, 0.0, 0.2, 0.6)] == ["<0", "0-0.2", "0.2-0.4", ">=0.6"]
    assert [one(spark, C.gap_bin(F.lit(v), 20)) for v in (-1.0, 0.0, 0.015, 5.0)] == [0, 0, 1, 19]
    assert one(spark, C.gap_bin_label(F.lit(19), 20)) == "[0.1900,+inf)"


def test_target_selection(spark):
    rows = lambda d: spark.createDataFrame([(t, b, float(v)) for t, bands in d.items() for b, v in bands.items()], "ts string, band string, completeness double")
    pick = lambda d, **k: dataflow.select_target(rows(d), "ts", "band", **k).first().ts
    full = {"a": {"x": 1, "y": 1}, "b": {"x": 1, "y": 0.5}, "c": {"x": 1, "y": 1}, "d": {"x": 0.1, "y": 0.1}}
    assert pick(full, late=0.5) == "c"
    assert pick(full, late=0.25) == "c"
    assert pick({"a": {"x": 0.4, "y": 0.5}, "b": {"x": 0.4, "y": 0.6}, "c": {"x": 0.1, "y": 1}}) == "b"
    assert pick({"2020-11-01": {"x": 0.5}, "2020-12-01": {"x": 0.5}}) == "2020-12-01"


def test_collapse_and_alignment(spark):
    df = spark.createDataFrame([(1, "A", 10.0), (1, "A", 50.0), (2, "A", 20.0), (2, "A", None)], "p int, ts string, v double")
    assert {r.p: r.v for r in dataflow.collapse_duplicates(df, ["p", "ts"], ["v"]).collect()} == {1: 30.0, 2: 20.0}
    b = spark.createDataFrame([("t1", "x"), ("t1", "y"), ("t2", "x")], "ts string, band string")
    assert [r.ts for r in dataflow.shared_times(b, "ts", "band").collect()] == ["t1"]


def test_window_offset():
    geo = [100.0, 0.1, 0.0, 50.0, 0.0, -0.1]
    assert dataflow.window_offset(geo, (7, 9), 3) == (2, 3)
    assert dataflow.window_offset(geo, (7, 9), 3, 100.0, 50.0) == (0, 0)
    with pytest.raises(ValueError):
        dataflow.window_offset(geo, (7, 9), 8)


def test_generator_streams(spark):
    g = sampling.Generator(7)
    want = [g.next() for _ in range(50)]
    assert sampling.states(7, 0, 50).tolist() == want and sampling.states(7, 20, 9).tolist() == want[20:29]
    assert sampling.Generator(0).state == sampling.ZERO_SEED
    rows = sampling.draws(spark, 25, 7, 10, per_draw=2).orderBy("draw").collect()
    assert [r.value for r in rows] == [w % 10 for w in want[::2]] and [int(r.seed) for r in rows] == want[1::2]


def test_breaks_restart(spark):
    df = spark.createDataFrame([(1, i, 9.0 if 3 <= i < 17 else 0.0, 1.0) for i in range(20)], "k int, i int, miss double, rmse double")
    assert sorted(r.break_position for r in windows.breaks(df, ["k"], "i", "miss", "rmse").collect()) == [3, 9]


def test_carry_forward_and_gaps(spark):
    df = spark.createDataFrame([(1, 0.0, True), (1, 1.0, True), (1, 4.0, True), (2, 0.0, False), (2, 1.0, True)], "k int, t double, ok boolean")
    got = {r.k: r for r in windows.gap_indices(df, ["k"], "t", "ok").collect()}
    assert got[1].gap_regular == pytest.approx((1 + 9) / 16) and got[2].gap_regular is None
    want = evaluation.gap_pair(np.array([0.0, 1, 4]), np.arange(3))
    assert got[1].gap_periodic == pytest.approx(want[1])


def make_series(spark, n=6):
    t = [float(i * 10) for i in range(40)]
    rows = [(k, t, [[1000.0 + 100 * k + 200 * float(np.sin(2 * np.pi * x / 365.25)), None if i == 3 else 500.0] for i, x in enumerate(t)], 200.0) for k in range(n)]
    return spark.createDataFrame(rows, "k int, t array<double>, y array<array<double>>, target double")


def test_vector_expression_equals_kernel(spark):
    s, c = make_series(spark), HarmonicConfig(modes=16)
    by_expression = {r.k: r.pred for r in models.evaluate_vector(models.fit_vector(s, ["k", "target"], c), ["k"], "target").collect()}
    for r in s.collect():
        t, y = models.arrays(r.t, r.y)
        want = harmonic.predict_vector(harmonic.fit_vector(t * 86400, y, c), r.target * 86400)[0]
        assert by_expression[r.k] == pytest.approx(want.tolist(), rel=1e-9)


def test_models_over_series(spark):
    s = make_series(spark)
    for method in ("harmonic", "hants", "zhu2015"):
        got = models.predict(s, ["k"], method).collect()
        assert len(got) == 6 and all(len(r.pred) == 2 for r in got)
    curve = models.predict_curve(s, ["k"], "hants", HantsConfig(), 11)
    assert curve.count() == 66
    assert models.fit_lasso(s, ["k"]).filter("band = 1").first().pred == pytest.approx(500.0)
    assert models.fit_steps(s, ["k"], [365.25]).filter("valid").count() == 12


def test_evaluation(spark):
    s = make_series(spark)
    e = evaluation.holdout_errors(s, ["k"], "hants", HantsConfig(fet=1e9))
    assert e.filter("status = 'evaluated'").count() == 12
    assert evaluation.holdout_errors(s, ["k"], "hants", None, least=100).select("status").distinct().first().status == "skipped"
    sweep = evaluation.sweep(s, ["k"], evaluation.grid({"modes": [8, 16]}), HarmonicConfig())
    assert [r.n for r in sweep.collect()] == [12, 12]


def test_metrics(spark):
    e = spark.createDataFrame([("a", 3.0), ("a", -1.0), ("b", 2.0)], "band string, error double")
    got = {r.band: r for r in metrics.error_metrics(e, ["band"]).collect()}
    assert got["a"].rmse == pytest.approx(5**0.5) and got[None].n == 3 and got[None].mae == 2.0
    bins = metrics.error_bins(e, ["band"])
    assert bins.count() == 12 and bins.filter("bin = '<=50' AND band = 'a'").first().n == 2
    pair = spark.createDataFrame([("s", 0.1, 0.7), ("s", 0.1, 0.1)], "scene string, t double, p double")
    c = metrics.confusion(pair, ["scene"], "t", "p")
    assert c.count() == 25 and c.filter("truth_class = '0-0.2' AND pred_class = '>=0.6'").first().n == 1


def test_stream_of_daily_means(spark, tmp_path):
    from chronopix.streaming.ingest import daily_means

    src = str(tmp_path / "in")
    spark.createDataFrame([("p", "2024-01-01 01:00:00", 1.0), ("p", "2024-01-01 05:00:00", 3.0), ("p", "2024-01-09 00:00:00", 5.0)], "k string, ts string, v double").withColumn("ts", F.to_timestamp("ts")).write.parquet(src)
    stream = spark.readStream.schema("k string, ts timestamp, v double").parquet(src)
    q = daily_means(stream, ["k"], "ts", "v").writeStream.outputMode("complete").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.n, r.v) for r in spark.table("daily").collect()) == [(1, 5.0), (2, 2.0)]


def test_numbers_of_more_rows_than_a_sample_of_ranges(spark):
    """Ranks and sums are those of one set of ranges, also where plans compute the rows twice with other columns."""
    from pyspark.sql import functions as F

    from chronopix.operators.ranges import numbered, running_sum

    df = spark.range(0, 60000, 1, 7).select((F.col("id") * 7919 % 20000).alias("k"), (F.col("id") % 5).alias("v")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))
    for parts in (3, 8):
        got = numbered(df, ["k"], "i", parts).select("i", "k", "n", "v").collect()
        assert sorted(r.i for r in got) == list(range(20000)) and all(r.i == r.k for r in got)
        sums = running_sum(df, ["k"], "n", "lo", parts).select("lo", "k", "v").collect()
        assert all(r.lo == 3 * r.k for r in sums)
    assert numbered(df.filter("n > 9"), ["k"], "i").collect() == []
