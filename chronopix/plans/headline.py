"""Production settings for the benchmark: the same operators as the registered queries, with all frequencies."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import HantsConfig, HarmonicConfig, LassoConfig
from ..operators import evaluation as E
from ..operators import metrics as M
from ..operators import models
from .modelling import ROBUST
from .registry import rounded, series

TWO = ["l_quantity", "l_discount"]


def evaluate_harmonic(spark: SparkSession, sf: str, modes: int = 64) -> DataFrame:
    e = E.holdout_errors(series(spark, sf), ["l_suppkey"], "harmonic", replace(ROBUST, modes=modes))
    return rounded(M.error_metrics(e.filter("status = 'evaluated'"), ["band"]), 4)


def evaluate_harmonic_200(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate_harmonic(spark, sf, 200)


def compare_methods(spark: SparkSession, sf: str) -> DataFrame:
    e = E.compare_methods(series(spark, sf, TWO), ["l_suppkey"], {"harmonic": ROBUST, "hants": HantsConfig(fet=20.0, sf="none"), "zhu2015": LassoConfig()})
    return rounded(e.filter("status = 'evaluated'").groupBy("method", "band").agg(*M.error_aggregates("error")), 4)


def vector_fit(spark: SparkSession, sf: str) -> DataFrame:
    return models.fit_vector(series(spark, sf), ["l_suppkey"], ROBUST).select("l_suppkey", "valid", "n_used", F.size("freqs").alias("n_freqs"))


def vector_predict(spark: SparkSession, sf: str) -> DataFrame:
    return models.evaluate_vector(models.fit_vector(series(spark, sf), ["l_suppkey", "target"], ROBUST), ["l_suppkey"], "target")


def scalar_steps(spark: SparkSession, sf: str) -> DataFrame:
    return models.predict_scalar(series(spark, sf, ["l_quantity"]), ["l_suppkey"], HarmonicConfig(modes=32, frequency_selection="hybrid"))


def hants(spark: SparkSession, sf: str) -> DataFrame:
    return models.fit_hants(series(spark, sf), ["l_suppkey"], HantsConfig(fet=20.0, sf="none"))


def lasso(spark: SparkSession, sf: str) -> DataFrame:
    return models.fit_lasso(series(spark, sf, TWO), ["l_suppkey"], LassoConfig())


def vector_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    return models.spectra(series(spark, sf), ["l_suppkey"], 64, "gridded")


def sweep(spark: SparkSession, sf: str) -> DataFrame:
    return E.sweep(series(spark, sf, TWO), ["l_suppkey"], E.grid({"ridge_lam": [0.05, 2.0], "modes": [16, 32]}), ROBUST)


#: Under the names of the registered queries, which have settings that SQL can follow.
HEADLINE = {
    "v2_evaluate_harmonic": evaluate_harmonic, "v2_modes_200": evaluate_harmonic_200, "v3_compare_methods": compare_methods, "e1_vector_fit": vector_fit, "e2_vector_predict": vector_predict,
    "e7_hants": hants, "e8_lasso": lasso, "e3_scalar_steps": scalar_steps, "k3_vector_spectrum": vector_spectrum, "v7_sweep": sweep,
}
