"""Queries that run the numeric kernels on every row of a table, beside their formulas in SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..kernels import basics, ridge, spectrum, steps
from .registry import query, rounded, table


def _rows(spark: SparkSession, sf: str, make: Callable[[float], tuple], schema: str) -> DataFrame:
    """p_partkey and what make gives for p_size, for every part."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([make(float(x)) for x in b["p_size"]], columns=names)
            yield pd.concat([b[["p_partkey"]].reset_index(drop=True), out], axis=1)

    return table(spark, sf, "part").select("p_partkey", "p_size").mapInPandas(run, f"p_partkey long, {schema}")


@query("k11_penalties", "WITH f AS (SELECT p_partkey, p_size + 20.0::DOUBLE AS d FROM part), r AS (SELECT *, sqrt(1 + 84 * log2(400 / d)) AS r FROM f) SELECT p_partkey, round(r, 9) AS penalty, 1.0::DOUBLE AS lowest, round(0.05 * r * r + CASE WHEN d < 60 THEN 0.15 ELSE 0 END, 9) AS tiered, 0.0::DOUBLE AS freed, round(1 + r, 9) AS diagonal FROM r")
def penalties(spark: SparkSession, sf: str) -> DataFrame:
    """Penalties of a period of 400 days and one of p_size + 20."""
    low = 1 / (400 * basics.DAY)

    def make(x: float) -> tuple:
        f = [low, 1 / ((x + 20) * basics.DAY)]
        p = ridge.frequency_penalty(f, 84)
        tiered = ridge.tiered_penalty(f, 0.05, 0.2, 60, 84)
        return float(p[1]), float(p[0]), float(tiered[-1]), float(ridge.tiered_penalty(f, 0.05, 0.2, 60, 84, free=[f[1]])[-1]), float(ridge.ridge_diagonal(f, 84)[0] + ridge.ridge_diagonal(f, 84)[-1])

    return rounded(_rows(spark, sf, make, "penalty double, lowest double, tiered double, freed double, diagonal double"), 9)


@query("k8_systems", "WITH p AS (SELECT p_partkey, p_size + 5.0::DOUBLE AS a FROM part) SELECT p_partkey, round(3 / (7 * a - 4), 9) AS x0, round((2 * a - 2) / (7 * a - 4), 9) AS x1, a = 9 AS singular, round(1 / a, 9) AS positive, round((3 * (5 + 2 * a) - 5 * (3 + a)) / (3 * (5 + a * a) - (3 + a) * (3 + a)), 9) AS slope, round((5 + 2 * a) / (5.5 + a * a), 9) AS shrunk FROM p")
def systems(spark: SparkSession, sf: str) -> DataFrame:
    """A 2 x 2 system, one that is singular for one size, a diagonal one, a line through three points, a ridge."""

    def make(x: float) -> tuple:
        a = x + 5
        both = ridge.solve(np.array([[a, 2.0], [2.0, 7.0]]), np.array([1.0, 2.0]))
        singular = ridge.solve(np.array([[a, 6.0], [6.0, 4.0]]), np.ones(2)) is None
        positive = ridge.positive_solve(np.diag([a, 2.0]), np.ones((2, 1)))
        t, y = np.array([[1.0], [2.0], [a]]), np.array([1.0, 2.0, 2.0])
        line = ridge.normal_solution(np.hstack([np.ones((3, 1)), t]), y)
        return float(both[0]), float(both[1]), singular, float(positive[0, 0]), float(line[1]), float(ridge.ridge_solution(t, y, 0.5, np.ones(1))[0])

    return rounded(_rows(spark, sf, make, "x0 double, x1 double, singular boolean, positive double, slope double, shrunk double"), 9)


@query("k24_tridiagonal", "SELECT p_partkey, round(-3 / (11 * a - 16), 9) AS x0, round((7 * a - 8) / (11 * a - 16), 9) AS x1, 0.0::DOUBLE AS zero FROM (SELECT p_partkey, p_size + 2.0::DOUBLE AS a FROM part)")
def tridiagonal(spark: SparkSession, sf: str) -> DataFrame:
    """Diag (a, 3, 4), off (2, 1), right side (1, 2, 1); N6: the transposed difference of a line is zero inside."""

    def make(x: float) -> tuple:
        a = x + 2
        out = steps.tridiagonal([a, 3.0, 4.0], [2.0, 1.0], np.array([[1.0], [2.0], [1.0]]))
        inner = steps.transposed_difference(np.array([[a], [a], [a]]))[1:-1]
        return float(out[0, 0]), float(out[1, 0]), float(np.abs(inner).max())

    return rounded(_rows(spark, sf, make, "x0 double, x1 double, zero double"), 9)


@query("k23_group_steps", "SELECT p_partkey, round(p_size / 3.0::DOUBLE, 9) AS flat, CAST(p_size AS DOUBLE) AS free, 0.0::DOUBLE AS far, p_size <= 12 AS kept FROM part")
def group_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Large weights give the mean, none the values, beyond a million nothing. K21: with one band, a score beyond the limit goes."""

    def make(x: float) -> tuple:
        r = np.array([[x, 1.0], [0.0, 1.0], [0.0, 1.0]])
        flat, free, far = (steps.group_fused_lasso(r, lam, np.ones(2)) for lam in (1e5, 0.0, 1e7))
        kept = steps.joint_outliers(np.array([[x, 9.0], [0.0, 9.0]]), [4.0, 0.0], 3.0)
        return float(flat[1, 0]), float(free[0, 0]), float(np.abs(far).max()), bool(kept[0])

    return rounded(_rows(spark, sf, make, "flat double, free double, far double, kept boolean"), 9)


@query("d9_units", "SELECT p_partkey, CASE WHEN p_size * 300 <= 10000 AND p_size * 2500 <= 100000 THEN p_size * 300 * 86400.0 ELSE p_size * 300.0 END AS last, CASE WHEN p_size * 300 <= 10000 AND p_size * 2500 <= 100000 THEN p_size * 2500 * 86400.0 ELSE p_size * 2500.0 END AS target FROM part")
def units(spark: SparkSession, sf: str) -> DataFrame:
    """Axes that look like days become seconds."""

    def make(x: float) -> tuple:
        t, target = basics.days_to_seconds([0.0, 300 * x], 2500 * x)
        return float(t[-1]), float(target)

    return _rows(spark, sf, make, "last double, target double")


BESSEL = "CASE WHEN {x} < 3.75 THEN " + " + ".join(f"{c} * pow({{x}} / 3.75, {2 * i})" for i, c in enumerate(spectrum.I0_SMALL)) + " ELSE exp({x}) / sqrt({x}) * (" + " + ".join(f"({c}) * pow(3.75 / {{x}}, {i})" for i, c in enumerate(spectrum.I0_LARGE)) + ") END"


@query("m4_kaiser_bessel", f"WITH p AS (SELECT p_partkey, p_size / 45.0::DOUBLE AS x FROM part), z AS (SELECT *, 10 * sqrt(greatest(0, 1 - x * x)) AS z, 10.0::DOUBLE AS b FROM p) SELECT p_partkey, round({BESSEL.format(x='z')}, 5) AS bessel, round(CASE WHEN x > 1 THEN 0 ELSE ({BESSEL.format(x='z')}) / ({BESSEL.format(x='b')}) END, 9) AS kaiser FROM z")
def kaiser(spark: SparkSession, sf: str) -> DataFrame:
    def make(x: float) -> tuple:
        z = 10 * np.sqrt(max(0.0, 1 - (x / 45) ** 2))
        return round(float(spectrum.bessel_i0(z)), 5), round(float(spectrum.kaiser_bessel(x / 45)), 9)

    return _rows(spark, sf, make, "bessel double, kaiser double")


@query("n9_merged", "SELECT p_partkey, CASE WHEN p_size <= 15 THEN [round(1 + p_size / 200.0, 9), 3.0] ELSE [1.0, round(1 + p_size / 100.0, 9), 3.0] END AS merged, CASE WHEN p_size <= 15 THEN 2 ELSE 3 END AS n FROM part")
def merged(spark: SparkSession, sf: str) -> DataFrame:
    """Frequencies 1, 1 + p_size / 100 and 3, neighbours within 15 % joined."""

    def make(x: float) -> tuple:
        out = spectrum.merge_near([1.0, 1 + x / 100, 3.0], 0.15)
        return [round(v, 9) for v in out], len(out)

    return _rows(spark, sf, make, "merged array<double>, n int")


@query("k29_frequencies", "WITH p AS (SELECT p_partkey, p_size, CASE WHEN p_size % 10 = 0 THEN 10 ELSE p_size % 10 END AS k FROM part) SELECT p_partkey, CAST(k AS INTEGER) AS strongest, 10 AS n_all, round(0.1::DOUBLE * CASE WHEN k IN (3, 4) THEN k ELSE 3 END, 9) AS preferred FROM p")
def frequencies(spark: SparkSession, sf: str) -> DataFrame:
    """A spectrum of ten bins with its peak at one: the strongest bin, all bins, and the preferred frequency 0.3 + 1/30 snapped
    to the bin with most power next to it."""
    from ..config import HarmonicConfig

    c = HarmonicConfig(refine_peaks=False, spectral_top_k=1, preferred_top_k=1)

    def make(x: float) -> tuple:
        k = int(x) % 10 or 10
        f = np.arange(11) * 0.1
        p = np.where(np.arange(11) == k, 100.0, 1.0)
        wanted = [0.3 + 1 / 30]
        one = spectrum.select_frequencies(f, p, 1.01, "spectral", [], c)
        every = spectrum.select_frequencies(f, p, 1.01, "all", [], c)
        near = spectrum.select_frequencies(f, p, 1.01, "preferred", wanted, c)
        return round(one[0] * 10), len(every), round(float(near[0]), 9)

    return _rows(spark, sf, make, "strongest int, n_all int, preferred double")


@query("m10_known_frequencies", "SELECT p_partkey, p_size IN (7, 30) AS known FROM part")
def known_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    f = 1 / (F.col("p_size") * 86400.0)
    return table(spark, sf, "part").select("p_partkey", C.frequency_matches_any(f, F.array(F.lit(1 / (7 * 86400.0)), F.lit(1 / (30 * 86400.0)))).alias("known"))


@query("g3_gap_labels", "SELECT p_partkey, CASE WHEN b = 19 THEN '[0.1900,+inf)' ELSE printf('[%.4f,%.4f)', b * 0.01, (b + 1) * 0.01) END AS label FROM (SELECT p_partkey, least(19, p_size - 1) AS b FROM part)")
def gap_labels(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").withColumn("bin", C.gap_bin((F.col("p_size") - 0.5) / 100, 20))
    return p.select("p_partkey", C.gap_bin_label("bin", 20).alias("label"))
