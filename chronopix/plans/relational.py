"""Queries for scans, masks, alignment, targets, windows and column functions; each has its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import dataflow as D
from ..operators import windows as W
from ..operators.ranges import running_sum
from .registry import BANDS, daily, day, observations, query, readings, rounded, seconds, table

DAILY = """daily AS (SELECT l_suppkey, l_shipdate, avg(l_quantity) AS l_quantity, avg(l_extendedprice) AS l_extendedprice,
  avg(l_discount) AS l_discount, avg(l_tax) AS l_tax FROM lineitem GROUP BY 1, 2)"""


@query("p1_valid_reflectance", "SELECT l_suppkey, count(*) FILTER (l_extendedprice > 0 AND l_extendedprice < 50000) AS n_valid, count(*) AS n FROM lineitem GROUP BY 1")
def valid_reflectance(spark: SparkSession, sf: str) -> DataFrame:
    ok = C.is_valid_reflectance("l_extendedprice", 0, 50_000)
    return observations(spark, sf).groupBy("l_suppkey").agg(F.count_if(ok).alias("n_valid"), F.count(F.lit(1)).alias("n"))


@query("p2_valid_mask", "SELECT user_id, count(*) FILTER (value > 0 AND value < 100) AS n_valid FROM events GROUP BY 1")
def mask_array(spark: SparkSession, sf: str) -> DataFrame:
    s = readings(spark, sf).groupBy("user_id").agg(F.collect_list("value").alias("ys"))
    return s.select("user_id", C.count_valid(C.valid_mask("ys", 0, 100)).cast("long").alias("n_valid"))


@query("p3_mask_invalid", "SELECT user_id, event_type, count(CASE WHEN value > 5 AND value < 100 THEN value END) AS n, round(avg(CASE WHEN value > 5 AND value < 100 THEN value END), 6) AS mean FROM events GROUP BY 1, 2")
def mask_invalid(spark: SparkSession, sf: str) -> DataFrame:
    m = D.mask_values(readings(spark, sf), "value", 5, 100)
    return rounded(m.groupBy("user_id", "event_type").agg(F.count("value").alias("n"), F.avg("value").alias("mean")))


@query("p5_joint_valid", "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 5 AND l_extendedprice < 50000 GROUP BY 1")
def joint_valid(spark: SparkSession, sf: str) -> DataFrame:
    m = D.mask_values(D.mask_values(observations(spark, sf), "l_quantity", 5, 1e9), "l_extendedprice", 0, 50_000)
    return D.joint_rows(m, BANDS).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("p6_eligible_pixels", f"WITH {DAILY} SELECT l_suppkey, count(*) FILTER (l_extendedprice < 50000) AS joint_valid FROM daily GROUP BY 1 HAVING count(*) FILTER (l_extendedprice < 50000) >= 12")
def eligible_pixels(spark: SparkSession, sf: str) -> DataFrame:
    m = D.mask_values(daily(spark, sf), "l_extendedprice", 0, 50_000)
    return D.eligible(m, ["l_suppkey"], BANDS, 12)


@query("p7_closed_range", "SELECT event_type, count(*) AS n FROM events WHERE value BETWEEN 10 AND 100 GROUP BY 1")
def closed_range(spark: SparkSession, sf: str) -> DataFrame:
    return readings(spark, sf).filter(C.in_range("value", 10, 100)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("p8_subsample", "SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem WHERE l_suppkey % 8 = 0 AND l_partkey % 8 = 0 GROUP BY 1, 2")
def subsample(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey")
    return D.subsample(li, 8, "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("s4_window_scan", "SELECT l_suppkey, l_partkey, l_quantity, l_tax FROM lineitem WHERE l_suppkey BETWEEN 3 AND 9 AND l_partkey BETWEEN 10 AND 209")
def window_scan(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_tax")
    return D.window(li, 3, 10, 7, 200, "l_suppkey", "l_partkey")


@query("p10_index_range", "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE (l_quantity - 25) / 20 BETWEEN -1 AND 1 GROUP BY 1")
def index_range(spark: SparkSession, sf: str) -> DataFrame:
    x = (F.col("l_quantity") - 25) / 20
    return observations(spark, sf).withColumn("x", C.within(x, -1, 1)).filter("x IS NOT NULL").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("j1_shared_times", "WITH d AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day FROM events) SELECT user_id, day, count(*) AS n FROM d WHERE (user_id, day) IN (SELECT (user_id, day) FROM d GROUP BY user_id, day HAVING count(DISTINCT event_type) >= 2) GROUP BY 1, 2")
def shared_times(spark: SparkSession, sf: str) -> DataFrame:
    e = readings(spark, sf).select("user_id", "event_type", F.to_date("ts").alias("day"))
    return D.align(e, "day", "event_type", 2, ("user_id",)).groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))


@query("u1_times_of_all_bands", "WITH d AS (SELECT DISTINCT event_type, CAST(ts AS DATE) AS day FROM events) SELECT day FROM d GROUP BY day HAVING count(*) = (SELECT count(DISTINCT event_type) FROM events)")
def times_of_all_bands(spark: SparkSession, sf: str) -> DataFrame:
    return D.shared_times(readings(spark, sf).withColumn("day", F.to_date("ts")), "day", "event_type")


@query("a5_collapse_duplicates", "SELECT l_suppkey, l_shipdate, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY 1, 2")
def collapse(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf)
    return d.select("l_suppkey", "l_shipdate", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_extendedprice", 4).alias("l_extendedprice"), F.round("l_discount", 6).alias("l_discount"), F.round("l_tax", 6).alias("l_tax"))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    e = readings(spark, sf).withColumn("day", F.to_date("ts"))
    return D.completeness(D.mask_values(e, "value", 5, 100), "day", "event_type", "value")


SCORES = """sc AS (SELECT CAST(ts AS DATE) AS day, event_type, avg(CASE WHEN value > 5 AND value < 100 THEN 1.0 ELSE 0.0 END) AS completeness FROM events GROUP BY 1, 2)"""
RATED = SCORES + """, k AS (SELECT count(DISTINCT event_type) AS k FROM sc),
rated AS (SELECT day, CAST(round(CASE WHEN count(*) = any_value(k) THEN min(completeness) ELSE 0 END * 1e9) AS BIGINT) AS min_scaled,
  CAST(round(sum(completeness) / any_value(k) * 1e9) AS BIGINT) AS mean_scaled FROM sc, k GROUP BY day)"""


@query("a6_completeness", f"WITH {SCORES} SELECT day, event_type, round(completeness, 9) AS completeness FROM sc")
def completeness(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_scores(spark, sf), 9)


@query("a7_validity_scores", f"WITH {RATED} SELECT day, round(min_scaled / 1e4) AS min_scaled, round(mean_scaled / 1e4) AS mean_scaled FROM rated")
def validity(spark: SparkSession, sf: str) -> DataFrame:
    v = D.validity_scores(_scores(spark, sf), "day", "event_type")
    return v.select("day", F.round(F.col("min_scaled") / 1e4).alias("min_scaled"), F.round(F.col("mean_scaled") / 1e4).alias("mean_scaled"))


TARGET = """WITH {rated}, n AS (SELECT count(*) AS n FROM rated),
r AS (SELECT day, min_scaled, mean_scaled, row_number() OVER (ORDER BY day DESC) AS back, n FROM rated, n),
p AS (SELECT *, CASE WHEN min_scaled >= {limit} AND back <= greatest(1, ceil(n * {late})) THEN 0 WHEN min_scaled >= {limit} THEN 1 ELSE 2 END AS pool FROM r)
SELECT day FROM p ORDER BY pool, CASE WHEN pool = 2 THEN min_scaled END DESC NULLS LAST, CASE WHEN pool = 2 THEN mean_scaled END DESC NULLS LAST, day DESC LIMIT 1"""


@query("o2_select_target", TARGET.format(rated=RATED, limit=700000000, late=0.25))
def select_target(spark: SparkSession, sf: str) -> DataFrame:
    return D.select_target(_scores(spark, sf), "day", "event_type", 0.7, 0.25)


@query("o2_select_target_fallback", TARGET.format(rated=RATED, limit=990000000, late=0.25))
def select_target_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return D.select_target(_scores(spark, sf), "day", "event_type", 0.99, 0.25)


@query("p9_hold_out", "WITH t AS (SELECT max(l_shipdate) AS t FROM lineitem) SELECT CASE WHEN l_shipdate = t THEN 'truth' ELSE 'train' END AS part, count(*) AS n, round(sum(l_quantity), 4) AS total FROM lineitem, t GROUP BY 1")
def hold_out(spark: SparkSession, sf: str) -> DataFrame:
    o = observations(spark, sf)
    train, truth = D.hold_out(o, "l_shipdate", o.agg(F.max("l_shipdate").alias("l_shipdate")))
    both = train.withColumn("part", F.lit("train")).unionByName(truth.withColumn("part", F.lit("truth")))
    return rounded(both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total")), 4)


@query("r5_hold_out_middle", f"WITH {DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM daily) SELECT l_suppkey, l_shipdate, round(l_quantity, 6) AS l_quantity FROM r WHERE i = n // 2")
def hold_out_middle(spark: SparkSession, sf: str) -> DataFrame:
    h = D.hold_out_middle(daily(spark, sf), ["l_suppkey"], "l_shipdate").filter("held_out")
    return h.select("l_suppkey", "l_shipdate", F.round("l_quantity", 6).alias("l_quantity"))


@query("w2_pivot_bands", "SELECT user_id, CAST(ts AS DATE) AS day, " + ", ".join(f"round(avg(CASE WHEN event_type = '{b}' THEN value END), 6) AS \"{b}\"" for b in ("click", "purchase", "view")) + " FROM events WHERE event_type IN ('click', 'purchase', 'view') GROUP BY 1, 2")
def pivot_bands(spark: SparkSession, sf: str) -> DataFrame:
    e = readings(spark, sf).withColumn("day", F.to_date("ts")).filter(F.col("event_type").isin("click", "purchase", "view"))
    means = D.collapse_duplicates(e, ["user_id", "day", "event_type"], ["value"])
    return rounded(D.pivot_bands(means, ["user_id", "day"], "event_type", "value", ["click", "purchase", "view"]))


@query("s9_union_chunks", "SELECT l_suppkey, count(*) AS n FROM (SELECT l_suppkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' UNION ALL SELECT l_suppkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01') GROUP BY 1")
def union_chunks(spark: SparkSession, sf: str) -> DataFrame:
    o = observations(spark, sf)
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    return D.merge_chunks([o.filter(F.col("l_shipdate") < cut), o.filter(F.col("l_shipdate") >= cut)]).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("j3_sites_missing", "SELECT s_suppkey, s_name, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49.5 AND l_discount > 0.095) AS found FROM supplier")
def sites(spark: SparkSession, sf: str) -> DataFrame:
    have = observations(spark, sf).filter("l_quantity > 49.5 AND l_discount > 0.095").select(F.col("l_suppkey").alias("s_suppkey"))
    return D.found_or_missing(table(spark, sf, "supplier").select("s_suppkey", "s_name"), have, "s_suppkey")


@query("j6_scene_dimension", "SELECT r_name, n_name, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def scene_dimension(spark: SparkSession, sf: str) -> DataFrame:
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    j = observations(spark, sf).select("l_suppkey", "l_quantity").join(s, F.col("l_suppkey") == s["s_suppkey"]).join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return rounded(j.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean")))


@query("j5_as_of_lookup", "WITH t AS (SELECT user_id, 1705276800.0 AS target FROM events GROUP BY 1), e AS (SELECT user_id, epoch(ts) AS t, value, event_id FROM events) SELECT t.user_id, round(coalesce((SELECT max_by(value, e.t) FROM e WHERE e.user_id = t.user_id AND e.t <= target), (SELECT min_by(value, e.t) FROM e WHERE e.user_id = t.user_id)), 6) AS value FROM t")
def as_of(spark: SparkSession, sf: str) -> DataFrame:
    s = readings(spark, sf).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("t", F.col("value").alias("v")))).alias("obs"))
    return rounded(s.select("user_id", C.last_at_or_before("obs", F.lit(1705276800.0)).alias("value")))


@query("j8_prefix_lookup", "WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT l_suppkey, sum(n) OVER (ORDER BY l_suppkey) - n AS lo, sum(n) OVER (ORDER BY l_suppkey) AS hi FROM c), q AS (SELECT o_orderkey AS draw, o_orderkey % (SELECT sum(n) FROM c) AS v FROM orders) SELECT draw, l_suppkey, CAST(v - lo AS BIGINT) AS inside FROM q JOIN p ON v >= lo AND v < hi")
def prefix_lookup(spark: SparkSession, sf: str) -> DataFrame:
    c = observations(spark, sf).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    p = running_sum(c, ["l_suppkey"], "n", "lo").select("l_suppkey", "lo", (F.col("lo") + F.col("n")).alias("hi"))
    total = c.agg(F.sum("n").alias("total"))
    q = table(spark, sf, "orders").select(F.col("o_orderkey").alias("draw")).join(F.broadcast(total)).withColumn("v", F.col("draw") % F.col("total"))
    return D.interval_lookup(q, "v", p, "lo", "hi").select("draw", "l_suppkey", (F.col("v") - F.col("lo")).cast("long").alias("inside"))


@query("n1_top_frequency", f"WITH {DAILY}, s AS (SELECT l_suppkey, epoch(l_shipdate) AS t, epoch(l_shipdate) - lag(epoch(l_shipdate)) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate) AS d FROM daily), m AS (SELECT l_suppkey, coalesce(median(CASE WHEN d > 0 THEN d END), (max(t) - min(t)) / count(*)) AS dt FROM s GROUP BY 1) SELECT l_suppkey, round(dt, 4) AS dt_median, round(0.5 / greatest(dt, 1e-12) * 1e9, 4) AS fmax_nhz FROM m")
def top_frequency(spark: SparkSession, sf: str) -> DataFrame:
    f = W.top_frequency(daily(spark, sf).withColumn("t", seconds("l_shipdate")), ["l_suppkey"], "t")
    return f.select("l_suppkey", F.round("dt_median", 4).alias("dt_median"), F.round(F.col("fmax") * 1e9, 4).alias("fmax_nhz"))


GAPS = """g AS (SELECT user_id, epoch(ts) AS t, value > 5 AND value < 100 AS ok FROM events),
sp AS (SELECT user_id, min(t) AS a, max(t) - min(t) AS w FROM g GROUP BY 1),
v AS (SELECT user_id, t, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS p FROM g WHERE ok),
x AS (SELECT v.user_id, t - p AS l, ((t + p) / 2 - a) / w AS tau, w FROM v JOIN sp USING (user_id) WHERE p IS NOT NULL AND w > 0),
gi AS (SELECT user_id, sum(l * l) / any_value(w * w) AS gap_regular, (pow(sum(l * cos(2 * pi() * tau)), 2) + pow(sum(l * sin(2 * pi() * tau)), 2)) / any_value(w * w) AS gap_periodic FROM x GROUP BY 1)"""


@query("g1_gap_indices", f"WITH {GAPS} SELECT sp.user_id, round(gap_regular, 8) AS gap_regular, round(gap_periodic, 8) AS gap_periodic FROM sp LEFT JOIN gi USING (user_id)")
def gap_indices(spark: SparkSession, sf: str) -> DataFrame:
    r = readings(spark, sf).withColumn("ok", C.is_valid_reflectance("value", 5, 100))
    return rounded(W.gap_indices(r, ["user_id"], "t", "ok"), 8)


@query("g2_gap_bins", f"WITH {GAPS} SELECT CAST(least(19, floor(greatest(gap_regular, 0) / 0.01)) AS INTEGER) AS bin, count(*) AS n FROM gi GROUP BY 1")
def gap_bins(spark: SparkSession, sf: str) -> DataFrame:
    r = readings(spark, sf).withColumn("ok", C.is_valid_reflectance("value", 5, 100))
    g = W.gap_indices(r, ["user_id"], "t", "ok").filter("gap_regular IS NOT NULL")
    return g.groupBy(C.gap_bin("gap_regular", 20).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("n3_difference_weights", f"WITH {DAILY}, d AS (SELECT l_suppkey, l_shipdate, (epoch(l_shipdate) - lag(epoch(l_shipdate)) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate)) / 86400 AS d FROM daily) SELECT l_suppkey, l_shipdate, round(1 / sqrt(greatest(d, 1)), 9) AS weight FROM d WHERE d IS NOT NULL")
def difference_weights(spark: SparkSession, sf: str) -> DataFrame:
    w = W.difference_weights(daily(spark, sf).withColumn("t", seconds("l_shipdate")), ["l_suppkey"], "t").filter(F.col("weight").isNotNull())
    return w.select("l_suppkey", "l_shipdate", F.round("weight", 9).alias("weight"))


@query("n4_breaks", """WITH m AS (SELECT user_id, avg(value) AS mu, 0.05 * stddev_pop(value) AS rmse FROM events GROUP BY 1),
r AS (SELECT e.user_id, row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id) - 1 AS i, abs(value - mu) > 2 * rmse AS far FROM events e JOIN m USING (user_id)),
s AS (SELECT *, sum(CASE WHEN far THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY i) AS island FROM r),
k AS (SELECT user_id, i, row_number() OVER (PARTITION BY user_id, island ORDER BY i) AS k FROM s WHERE far)
SELECT user_id, CAST(greatest(0, i - 5) AS BIGINT) AS break_position FROM k WHERE k % 6 = 0""")
def find_breaks(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf, "events")
    m = e.groupBy("user_id").agg(F.avg("value").alias("mu"), (0.05 * F.stddev_pop("value")).alias("rmse"))
    rows = e.join(m, "user_id").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).withColumn("miss", F.col("value") - F.col("mu"))
    return W.breaks(rows, ["user_id"], "i", "miss", "rmse")


@query("n5_temporal_rmse", f"WITH {DAILY}, d AS (SELECT l_suppkey, l_quantity, epoch(l_shipdate) / 86400 AS t FROM daily), g AS (SELECT *, abs(t % 365.25::DOUBLE - 100) AS g FROM d), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN g > 182.625 THEN 365.25 - g ELSE g END, t) AS k FROM g) SELECT l_suppkey, round(CASE WHEN count(*) >= 24 THEN stddev_pop(l_quantity) END, 6) AS temporal_rmse FROM k WHERE k <= 24 GROUP BY 1")
def temporal_rmse(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf).withColumn("t", day("l_shipdate"))
    return rounded(W.temporal_rmse(d, ["l_suppkey"], "t", "l_quantity", 100.0, 24))


@query("n7_carry_forward", "WITH e AS (SELECT user_id, event_id, ts, CASE WHEN value > 5 AND value < 60 THEN value END AS v FROM events) SELECT user_id, event_id, round(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS v FROM e")
def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    e = D.mask_values(table(spark, sf, "events"), "value", 5, 60)
    return rounded(D.carried_forward(e, ["user_id"], ["ts", "event_id"], "value").select("user_id", "event_id", F.col("value_carried").alias("v")))


SPECTRUM = """x AS (SELECT user_id, epoch(ts) / 86400 AS t, value FROM events),
sp AS (SELECT user_id, min(t) AS a, max(t) - min(t) AS w FROM x GROUP BY 1),
f AS (SELECT x.user_id, w, k, 2 * pi() * (t - a) / w - pi() AS p, value AS y FROM x JOIN sp USING (user_id), generate_series(0, 15) g(k) WHERE w > 0),
pw AS (SELECT user_id, CAST(k AS INTEGER) AS k, k / any_value(w) AS freq, pow(sum(y * cos(k * p)), 2) + pow(sum(y * sin(k * p)), 2) AS power FROM f GROUP BY user_id, k)"""


def _spectrum(spark: SparkSession, sf: str) -> DataFrame:
    return W.direct_spectrum(readings(spark, sf).withColumn("d", F.col("t") / 86400.0), ["user_id"], "d", "value", 32)


@query("k1_direct_spectrum", f"WITH {SPECTRUM} SELECT user_id, k, round(freq, 6) AS freq, round(power, 2) AS power FROM pw")
def direct_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    return _spectrum(spark, sf).select("user_id", "k", F.round("freq", 6).alias("freq"), F.round("power", 2).alias("power"))


@query("n8_top_power", f"WITH {SPECTRUM}, c AS (SELECT *, sum(power) OVER (PARTITION BY user_id ORDER BY power DESC, freq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, row_number() OVER (PARTITION BY user_id ORDER BY power DESC, freq) AS rank, sum(power) OVER (PARTITION BY user_id) AS a FROM pw WHERE k > 0) SELECT user_id, k, rank FROM c WHERE rank = 1 OR (rank <= 8 AND b < 0.7 * a)")
def top_power(spark: SparkSession, sf: str) -> DataFrame:
    return W.top_power(_spectrum(spark, sf).filter("k > 0"), ["user_id"], "freq", "power", 8, 0.7).select("user_id", "k", F.col("rank").cast("long").alias("rank"))


@query("m6_parabola", f"WITH {SPECTRUM}, n AS (SELECT *, lag(power) OVER w AS p0, lead(power) OVER w AS p2, lead(freq) OVER w AS f2 FROM pw WINDOW w AS (PARTITION BY user_id ORDER BY freq)) SELECT user_id, k, round(coalesce(CASE WHEN p0 - 2 * power + p2 <> 0 THEN freq + 0.5 * (p0 - p2) / (p0 - 2 * power + p2) * (f2 - freq) END, freq), 5) AS refined FROM n WHERE k <= 8")
def refined_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return W.peaks_refined(_spectrum(spark, sf), ["user_id"]).filter("k <= 8").select("user_id", "k", F.round("refined", 5).alias("refined"))


@query("m7_snap", f"WITH {SPECTRUM}, d AS (SELECT user_id, freq - lag(freq) OVER (PARTITION BY user_id ORDER BY freq) AS d FROM pw), m AS (SELECT user_id, d, row_number() OVER (PARTITION BY user_id ORDER BY d) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM d WHERE d > 0), df AS (SELECT user_id, d AS df FROM m WHERE r = n // 2 + 1), c AS (SELECT user_id, freq, power, abs(freq - 0.1415) / df AS z FROM pw JOIN df USING (user_id) WHERE freq > 0 AND abs(freq - 0.1415) <= df) SELECT user_id, round(max_by(freq, power * pow(CASE WHEN z < 1e-8 THEN 1 ELSE sin(pi() * z) / (pi() * z) END, 2)), 6) AS snapped FROM c GROUP BY 1")
def snap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(W.snapped(_spectrum(spark, sf), ["user_id"], 0.1415))


@query("f1_timestamp_text", "SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y%m%dT%H%M%S') AS stamp, epoch(l_shipdate) AS epoch FROM lineitem")
def timestamp_text(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("S2_"), F.date_format("l_shipdate", "yyyyMMdd'T'HHmmss"), F.lit("_T48RVV_B2"))
    li = table(spark, sf, "lineitem").withColumn("stamp", C.stamp(text))
    return li.select("l_orderkey", "l_linenumber", "stamp", C.epoch_seconds("stamp").alias("epoch"))


@query("f4_safe_component", "SELECT p_partkey, regexp_replace(p_brand || '#' || p_type, '[^A-Za-z0-9_-]', '_', 'g') AS safe FROM part")
def safe(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", C.safe_component(F.concat("p_brand", F.lit("#"), "p_type")).alias("safe"))


@query("f5_location_token", "SELECT s_suppkey, printf('lon%.4f_lat%.4f', (s_suppkey % 360) - 180 + 0.25, (s_nationkey - 12) * 3.5) AS token FROM supplier")
def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select("s_suppkey", C.location_token((F.col("s_suppkey") % 360) - 180 + F.lit(0.25), (F.col("s_nationkey") - 12) * F.lit(3.5)).alias("token"))


@query("f2_band_files", "SELECT s_suppkey, 'B' || (s_suppkey % 12 + 1) AS band, (s_suppkey % 360) - 180 + 0.25::DOUBLE AS lon, (s_nationkey - 12) * 3.5::DOUBLE AS lat FROM supplier")
def band_files(spark: SparkSession, sf: str) -> DataFrame:
    name = F.format_string("COPERNICUS_S2_HARMONIZED_B%d_lon%.4f_lat%.4f-0000000000-0000001024", F.col("s_suppkey") % 12 + 1, (F.col("s_suppkey") % 360) - 180 + F.lit(0.25), (F.col("s_nationkey") - 12) * F.lit(3.5))
    return table(spark, sf, "supplier").select("s_suppkey", C.band_file(C.strip_chunk(name)).alias("p")).select("s_suppkey", "p.*")


@query("s8_complete_locations", "WITH f AS (SELECT DISTINCT s_nationkey AS n, s_suppkey % 12 + 1 AS b FROM supplier) SELECT n * 2.5::DOUBLE AS lon, n * 1.5::DOUBLE AS lat FROM f WHERE b IN (2, 3, 4, 8, 11, 12) GROUP BY n HAVING count(DISTINCT b) = 6")
def complete_locations(spark: SparkSession, sf: str) -> DataFrame:
    name = F.format_string("x/COPERNICUS_S2_HARMONIZED_B%d_lon%.4f_lat%.4f.tif", F.col("s_suppkey") % 12 + 1, F.col("s_nationkey") * F.lit(2.5), F.col("s_nationkey") * F.lit(1.5))
    return D.complete_locations(table(spark, sf, "supplier").select(name.alias("path")), "path")


@query("f9_preferred_frequencies", "SELECT p_size, count(*) AS n, round(1e9 / ((p_size + 300.25) * 86400), 6) AS nhz FROM part GROUP BY 1")
def preferred(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat((F.col("p_size") + 300.25).cast("string"), F.lit(",x,-4"))
    f = table(spark, sf, "part").select("p_size", C.preferred_frequencies(text).alias("f")).select("p_size", F.element_at("f", 1).alias("f"))
    return rounded(f.groupBy("p_size").agg(F.count(F.lit(1)).alias("n"), (F.first("f") * 1e9).alias("nhz")))


@query("f11_md5", "SELECT p_partkey, md5(p_name) AS md5 FROM part")
def md5(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.md5("p_name").alias("md5"))


@query("f12_fingerprint", "SELECT s_nationkey, md5(string_agg('band=' || s_name || chr(10) || 'path=' || s_suppkey || chr(10) || 'len=' || s_nationkey || chr(10) || 'mtime=0', chr(10) ORDER BY 'band=' || s_name || chr(10) || 'path=' || s_suppkey || chr(10) || 'len=' || s_nationkey || chr(10) || 'mtime=0')) AS fingerprint FROM supplier GROUP BY 1")
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").groupBy("s_nationkey").agg(C.fingerprint("s_name", F.col("s_suppkey").cast("string"), "s_nationkey", F.lit(0)).alias("fingerprint"))


@query("d3_relative_days", "SELECT user_id, event_id, round((epoch(ts) - min(epoch(ts)) OVER (PARTITION BY user_id)) / 86400, 9) AS days FROM events")
def relative_days(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("t", seconds("ts"))
    return rounded(D.relative_days(e, ["user_id"], "t").select("user_id", "event_id", "days"), 9)


@query("d4_text_days", "SELECT o_orderkey, o_custkey, epoch(o_orderdate) AS epoch, round((epoch(o_orderdate) - min(epoch(o_orderdate)) OVER (PARTITION BY o_custkey)) / 86400, 9) AS days FROM orders")
def text_days(spark: SparkSession, sf: str) -> DataFrame:
    """Times as texts in three formats, all or none of which must be readable."""
    formats = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss"))
    text = formats.otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", C.epoch_seconds_or_raise(text).alias("epoch"))
    return rounded(D.relative_days(o, ["o_custkey"], "epoch"), 9)


@query("d8_time_axis", "WITH t AS (SELECT user_id, max(epoch(ts)) AS target, min(epoch(ts)) AS a FROM events GROUP BY 1) SELECT e.user_id, event_id, round((epoch(ts) - a) / 86400, 9) AS day, round((target - a) / 86400, 9) AS target_day FROM events e JOIN t USING (user_id) WHERE epoch(ts) <> target")
def axis(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("t", seconds("ts"))
    last = e.groupBy("user_id").agg(F.max("t").alias("target"))
    masked = e.join(last, "user_id").filter("t <> target")
    return rounded(D.time_axis(masked, ["user_id"], "t", "target").select("user_id", "event_id", "day", "target_day"), 9)


@query("j4_scored_scenes", "WITH s AS (SELECT l_suppkey AS p, max(l_discount * 10) AS score FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY 1) SELECT s_suppkey, CASE WHEN score > 0.99 THEN s_acctbal END AS value FROM supplier JOIN s ON s_suppkey = p")
def scored_scenes(spark: SparkSession, sf: str) -> DataFrame:
    scores = table(spark, sf, "lineitem").filter("l_suppkey % 3 <> 0").select(F.col("l_suppkey").alias("s_suppkey"), (F.col("l_discount") * 10).alias("score"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("value"))
    return D.scored(s, scores, "s_suppkey", "score", "value", 0.99)


@query("f13_texts", "SELECT p_partkey, CASE WHEN n >= 1073741824 THEN printf('%.2f GiB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.2f MiB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.2f KiB', n / 1024.0) ELSE n || ' B' END AS size, CASE WHEN s < 0 THEN 'unknown' WHEN s >= 3600 THEN printf('%.2f h', s / 3600) WHEN s >= 60 THEN printf('%.1f min', s / 60) ELSE printf('%.1f s', s) END AS duration FROM (SELECT p_partkey, CAST(1 << (p_partkey % 33) AS BIGINT) AS n, CAST((p_size - 5) * (p_size - 5) * (p_size - 5) / 8.0 AS DOUBLE) AS s FROM part)")
def texts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_size") - 5
    p = table(spark, sf, "part").select("p_partkey", F.expr("shiftleft(1L, cast(p_partkey % 33 as int))").alias("n"), (k * k * k / 8.0).cast("double").alias("s"))
    return p.select("p_partkey", C.size_text("n").alias("size"), C.duration_text("s").alias("duration"))


@query("x10_band_positions", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 5 WHEN p_size % 7 >= 4 THEN 4 END AS position FROM part")
def band_positions(spark: SparkSession, sf: str) -> DataFrame:
    """The near-infrared band: named fifth in some rasters, in others the fourth of as many bands as there are."""
    names = F.when(F.col("p_size") % 3 == 0, F.array(*[F.lit(x) for x in ("a", "b", "c", "d", "B8")])).otherwise(F.array(F.lit(""), F.lit("x")))
    return table(spark, sf, "part").select("p_partkey", C.band_position(names, F.col("p_size") % 7, "B8").alias("position"))


@query("u2_joined_frequencies", "SELECT p_partkey, CASE WHEN b - a <= 0.15 * a THEN [round((a + b) / 2, 9)] ELSE [round(a, 9), round(b, 9)] END AS freqs FROM (SELECT p_partkey, least(x, 20.0::DOUBLE) AS a, greatest(x, 20.0::DOUBLE) AS b FROM (SELECT p_partkey, p_size + 0.3::DOUBLE AS x FROM part))")
def joined_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.array(F.col("p_size") + 0.3).alias("own"))
    joined = C.joined_frequencies(F.array(F.lit(20.0)), "own", 0.15)
    return p.select("p_partkey", F.transform(joined, lambda x: F.round(x, 9)).alias("freqs"))


@query("m9_high_tier", "SELECT p_partkey, 1 / (1 / (p_size * 86400.0::DOUBLE) * 86400.0) < 30 AS high FROM part")
def high_tier(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", C.is_high_tier(1 / (F.col("p_size") * 86400.0), 30).alias("high"))


@query("f6_stack_paths", "SELECT s_suppkey, printf('out/S2_recon/%.4f_%.4f/', s_suppkey % 360 - 180 + 0.5, s_nationkey * 2.0) || '[harmonic]_S2_' || printf('lon%.6f_lat%.6f', s_suppkey % 360 - 180 + 0.5, s_nationkey * 2.0) || '_2020-01-02T03-04-05_prediction.tif' AS path FROM supplier")
def stack_paths(spark: SparkSession, sf: str) -> DataFrame:
    lon, lat = F.col("s_suppkey") % 360 - 180 + F.lit(0.5), F.col("s_nationkey") * F.lit(2.0)
    return table(spark, sf, "supplier").select("s_suppkey", C.stack_path("out/", F.lit("harmonic"), "S2", lon, lat, F.lit("2020-01-02T03:04:05")).alias("path"))


@query("s7_band_stacks", "SELECT 'B' || (s_suppkey % 12 + 1) AS band, count(*) AS n, min('x/COPERNICUS_S2_HARMONIZED_B' || (s_suppkey % 12 + 1) || '_lon1.5_lat' || s_suppkey || '.tif') AS first FROM supplier GROUP BY 1")
def stacks(spark: SparkSession, sf: str) -> DataFrame:
    name = F.format_string("x/COPERNICUS_S2_HARMONIZED_B%d_lon1.5_lat%d.tif", F.col("s_suppkey") % 12 + 1, F.col("s_suppkey"))
    found = D.band_stacks(table(spark, sf, "supplier").select(name.alias("path")), "path")
    return found.select("band", F.size("paths").cast("long").alias("n"), F.element_at("paths", 1).alias("first"))


@query("d11_fractional_year", "SELECT o_orderkey, round(year(o_orderdate) + (epoch(o_orderdate) - epoch(date_trunc('year', o_orderdate))) / (epoch(date_trunc('year', o_orderdate) + INTERVAL 1 YEAR) - epoch(date_trunc('year', o_orderdate))), 9) AS year FROM orders")
def fractional(spark: SparkSession, sf: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    first = F.trunc(d, "year")
    share = F.datediff(d, first) / F.datediff(F.add_months(first, 12), first)
    return rounded(table(spark, sf, "orders").select("o_orderkey", (F.year(d) + share).alias("year")), 9)


@query("d12_day_gap", "SELECT o_orderkey, round(CASE WHEN g > 182.625 THEN 365.25 - g ELSE g END, 6) AS gap FROM (SELECT o_orderkey, abs((epoch(o_orderdate) / 86400) % 365.25::DOUBLE - 200) AS g FROM orders)")
def day_gap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(table(spark, sf, "orders").select("o_orderkey", C.day_of_year_gap(day("o_orderdate"), F.lit(200.0)).alias("gap")))


@query("m_number_functions", """SELECT p_partkey, ((p_size + 1) >> 1) * 2 AS next_even, CAST(CASE WHEN p_size <= 2 THEN 2 ELSE pow(2, ceil(log2(p_size))) END AS BIGINT) AS next_pow2,
  round(CASE WHEN x = 0 THEN 1 ELSE sin(pi() * x) / (pi() * x) END, 9) AS sinc, round(CASE WHEN x > 1.5 THEN x - 1.5 WHEN x < -1.5 THEN x + 1.5 ELSE 0 END, 6) AS soft, round(CASE WHEN abs(x) <= 1.25 THEN 1 ELSE 1.25 / abs(x) END, 9) AS huber,
  CASE WHEN p_size < 6 THEN 0 WHEN p_size < 18 THEN 1 WHEN p_size < 24 THEN 2 ELSE 3 END AS model_order, x > 3 AS high, x < -3 AS low, abs(x) > 3 AS far
FROM (SELECT *, (p_size - 25) / 4.0::DOUBLE AS x FROM part)""")
def numbers(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").withColumn("x", (F.col("p_size") - 25) / 4.0)
    return rounded(
        p.select(
            "p_partkey", C.next_even("p_size").alias("next_even"), C.next_power_of_two("p_size").alias("next_pow2"), C.sinc("x").alias("sinc"), C.soft_threshold("x", F.lit(1.5)).alias("soft"),
            C.huber_weight("x", 1.25).alias("huber"), C.model_order("p_size").alias("model_order"), C.is_outlier("x", 3, "high").alias("high"), C.is_outlier("x", 3, "low").alias("low"), C.is_outlier("x", 3, "none").alias("far"),
        ), 9,
    )


@query("o1_band_order", "SELECT band, CAST(row_number() OVER (ORDER BY n, s) AS BIGINT) AS position FROM (SELECT DISTINCT band, coalesce(TRY_CAST(regexp_extract(band, '^B([0-9]+)', 1) AS INTEGER), 10000) AS n, CASE WHEN regexp_matches(band, '^B[0-9]') THEN regexp_extract(band, '^B[0-9]+(.*)$', 1) ELSE band END AS s FROM (SELECT CASE WHEN p_size % 7 = 0 THEN 'X' || p_size WHEN p_size % 5 = 0 THEN 'B' || p_size || 'A' ELSE 'B' || p_size END AS band FROM part))")
def band_order(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    s = F.col("p_size").cast("string")
    band = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("X"), s)).when(F.col("p_size") % 5 == 0, F.concat(F.lit("B"), s, F.lit("A"))).otherwise(F.concat(F.lit("B"), s))
    names = table(spark, sf, "part").select(band.alias("band")).distinct()
    return names.select("band", F.row_number().over(Window.orderBy(*C.band_order("band"))).cast("long").alias("position"))


INDEX_BANDS = {"B2": "l_quantity * 40", "B3": "l_quantity * 50 + 100", "B4": "l_extendedprice / 20", "B8": "l_extendedprice / 12 + 400", "B11": "l_discount * 40000 + 300", "B12": "l_tax * 50000 + 200"}


@query("x_spectral_indices", "WITH b AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"({e}) / 10000 AS {k}" for k, e in INDEX_BANDS.items()) + """ FROM lineitem)
SELECT l_orderkey, l_linenumber, round((B8 - B4) / (B8 + B4), 6) AS ndvi, round(CASE WHEN abs(B8 + 6 * B4 - 7.5 * B2 + 1) > 1e-6 THEN 2.5 * (B8 - B4) / (B8 + 6 * B4 - 7.5 * B2 + 1) END, 6) AS evi, round((B3 - B8) / (B3 + B8), 6) AS ndwi,
  round((B3 - B11) / (B3 + B11), 6) AS ndsi, round((B8 - B11) / (B8 + B11), 6) AS ndmi, round((B8 - B12) / (B8 + B12), 6) AS nbr FROM b""")
def indices(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(e).alias(k) for k, e in INDEX_BANDS.items()])
    return rounded(li.select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in C.spectral_indices().items()]))


@query("array_dense_grid", f"WITH {DAILY}, s AS (SELECT l_suppkey, min(epoch(l_shipdate) / 86400) AS a, max(epoch(l_shipdate) / 86400) AS b FROM daily GROUP BY 1) SELECT l_suppkey, CAST(i AS INTEGER) AS i, round(a + (b - a) * i / 239, 6) AS t FROM s, generate_series(0, 239) g(i)")
def dense_grid(spark: SparkSession, sf: str) -> DataFrame:
    s = daily(spark, sf).withColumn("d", day("l_shipdate")).groupBy("l_suppkey").agg(F.min("d").alias("a"), F.max("d").alias("b"))
    return rounded(s.select("l_suppkey", F.posexplode(C.dense_grid("a", "b")).alias("i", "t")))


@query("d10_synthetic_times", "SELECT s_suppkey, CAST(i AS INTEGER) AS i FROM supplier, generate_series(0, 9) g(i)")
def synthetic_times(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "supplier").select("s_suppkey", F.explode(C.synthetic_days(F.lit(10))).alias("i"))
    return days.withColumn("i", F.col("i").cast("int"))
