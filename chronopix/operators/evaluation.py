"""Hold-out evaluation and parameter sweeps."""

from __future__ import annotations

import itertools
import time
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame

from ..config import Algorithm, HarmonicConfig
from ..kernels import harmonic, spectrum
from ..kernels.basics import DAY
from . import metrics, models
from .sampling import Generator

ERROR_SCHEMA = "method string, status string, target double, band int, pred double, truth double, error double, gap_regular double, gap_periodic double, reason string"


def gap_pair(t: np.ndarray, kept: np.ndarray) -> tuple[float | None, float | None]:
    """Gap indices of the kept dates over the span of all dates."""
    span = t[-1] - t[0] if len(t) else 0.0
    v = t[kept]
    if len(v) < 2 or not span > 0:
        return None, None
    gap, tau = np.diff(v), ((v[1:] + v[:-1]) / 2 - t[0]) / span
    wave = (gap * np.exp(2j * np.pi * tau)).sum()
    return float(np.clip((gap**2).sum() / span**2, 0, 1)), float(np.clip(abs(wave) ** 2 / span**2, 0, 1))


def _hold_out(r: dict, least: int, seed: str | None, low: float | None, high: float | None):
    """(times, values, position held out, training values), or None with too few joint-valid dates."""
    t, y = models.arrays(r["t"], r["y"])
    if low is not None:
        y = np.where((y > low) & (y < high), y, np.nan)
    valid = np.flatnonzero(np.isfinite(y).all(1))
    if len(valid) <= least:
        return None
    at = int(valid[Generator(int(r[seed])).below(len(valid))] if seed else valid[len(valid) // 2])
    train = y.copy()
    train[at] = np.nan
    return t, y, at, train


def compare_methods(series: DataFrame, keys: list[str], configs: dict[str, object], least: int = 12, seed: str | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """V1-V3: one date of each pixel is held out, the rest is fitted by each method, and each band's error comes back.

    The date is drawn from the row's seed (an unsigned text) or, without one, the middle joint-valid date. Pixels with
    `least` or fewer joint-valid dates are skipped, and so are pixels whose fit raises, with what it said as reason; without a
    finite prediction a pixel has failed. A series is read once for all methods.
    """
    runs = [(Algorithm.parse(m), models.predictor(Algorithm.parse(m), c)) for m, c in configs.items()]

    def make(r):
        none = (None,) * 7
        held = _hold_out(r, least, seed, low, high)
        if held is None:
            for which, _ in runs:
                yield which.value, "skipped", *none, f"{least} joint dates or fewer"
            return
        t, y, at, train = held
        regular, periodic = gap_pair(t, np.flatnonzero(np.isfinite(train).all(1)))
        for which, run in runs:
            try:
                pred = run(t, train, t[at : at + 1])[0]
            except (ValueError, np.linalg.LinAlgError) as e:
                yield which.value, "skipped", *none, str(e)
                continue
            if not np.isfinite(pred).all():
                yield which.value, "failed", *none, "the prediction is not finite"
                continue
            for b in range(y.shape[1]):
                yield which.value, "evaluated", float(t[at]), b, float(pred[b]), float(y[at, b]), float(pred[b] - y[at, b]), regular, periodic, None

    return models.map_series(series, make, ERROR_SCHEMA, keys)


def holdout_errors(series: DataFrame, keys: list[str], method: str, config=None, least: int = 12, seed: str | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """V1: compare_methods() with one method."""
    return compare_methods(series, keys, {method: config}, least, seed, low, high)


def timings(series: DataFrame, keys: list[str], config: HarmonicConfig | None = None, repeats: int = 1, least: int = 12) -> DataFrame:
    """V4: for each pixel with enough dates: keys, spectrum_seconds, fit_seconds (each the mean of `repeats` runs), n_freqs, squared error
    of the held-out date over all bands."""
    c = config or HarmonicConfig()

    def make(r):
        held = _hold_out(r, least, None, None, None)
        if held is None:
            return
        t, y, at, train = held
        ok = np.isfinite(train).all(1)
        rel = (t[ok] - t[ok].min()) * DAY
        began = time.perf_counter()
        for _ in range(repeats):
            spectrum.power(rel, train[ok], c.modes, method=c.spectrum)
        between = time.perf_counter()
        for _ in range(repeats):
            model = harmonic.fit_vector(t * DAY, train, c)
            pred = harmonic.predict_vector(model, t[at] * DAY)[0]
        done = time.perf_counter()
        yield (between - began) / repeats, (done - between) / repeats, len(model.freqs), float(((pred - y[at]) ** 2).mean())

    return models.map_series(series, make, "spectrum_seconds double, fit_seconds double, n_freqs int, squared_error double", keys)


def candidate_name(params: dict) -> str:
    """F10."""
    return "_".join(f"{k}-{v:g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else f"{k}-{v}" for k, v in params.items())


def phase_label(name: str) -> str:
    """the label of a sweep's result file."""
    return name.replace("_20k_results.csv", "").replace("_results.csv", "").replace("phase", "p")


def grid(options: dict[str, list]) -> list[dict]:
    return [dict(zip(options, v, strict=True)) for v in itertools.product(*options.values())]


def sweep(series: DataFrame, keys: list[str], candidates: list[dict], base: HarmonicConfig | None = None, least: int = 12) -> DataFrame:
    """V7: all candidates over all pixels in one job, each series read once: candidate, n, rmse, mae, bias by rising rmse."""
    base = base or HarmonicConfig()
    runs = [(candidate_name(c), models.predictor(Algorithm.HARMONIC, replace(base, **c))) for c in candidates]

    def make(r):
        held = _hold_out(r, least, None, None, None)
        if held is None:
            return
        t, y, at, train = held
        for name, run in runs:
            for e in run(t, train, t[at : at + 1])[0] - y[at]:
                if np.isfinite(e):
                    yield name, float(e)

    errors = models.map_series(series, make, "candidate string, error double", [])
    return errors.groupBy("candidate").agg(*metrics.error_aggregates("error")).drop("mse").orderBy("rmse")
