"""Harmonic analysis with removal of outliers."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .basics import nanmedian
from .ridge import design, normal_solution


@dataclass
class HarmonicFit:
    valid: bool
    nof: int
    period: float
    coeffs: np.ndarray
    fill_value: float
    n_iterations: int = 0
    kept: int = field(default=0)


def outliers(residuals, fet: float, sf: str) -> np.ndarray:
    r = np.asarray(residuals, dtype=np.float64)
    return r < -fet if sf == "low" else r > fet if sf == "high" else np.abs(r) > fet


def harmonic_design(t, nof: int, period: float) -> np.ndarray:
    return design(t, np.arange(1, nof) / period, trend=False)


def fit(t, y, config) -> HarmonicFit:
    """Least squares on nof - 1 harmonics; each pass drops all observations beyond the tolerance on the suppressed side.

    With config.passes, the fit of that pass is taken even if some are still beyond it.
    """
    t, y = np.asarray(t, dtype=np.float64), np.asarray(y, dtype=np.float64)
    size = 1 + 2 * (max(config.nof, 1) - 1)
    least = size + config.dod
    out = HarmonicFit(False, config.nof, config.period, np.full(size, np.nan), nanmedian(y))
    ok = np.isfinite(y)
    if config.valid_min is not None:
        ok &= y >= config.valid_min
    if config.valid_max is not None:
        ok &= y <= config.valid_max
    t, y = t[ok], y[ok]
    coeffs = None
    for turn in range(min(len(y), 50)):
        if len(y) < least:
            return out
        x = harmonic_design(t, config.nof, config.period)
        coeffs = normal_solution(x, y)
        if coeffs is None:
            return out
        bad = outliers(y - x @ coeffs, config.fet, config.sf)
        out.n_iterations = turn + 1
        if not bad.any() or turn + 1 == config.passes:
            break
        t, y, coeffs = t[~bad], y[~bad], None
    if not len(y) or len(y) < least:
        return out
    if coeffs is None:
        coeffs = normal_solution(harmonic_design(t, config.nof, config.period), y)
        if coeffs is None:
            return out
    out.valid, out.coeffs, out.kept = True, coeffs, len(y)
    return out


def predict(model: HarmonicFit, t) -> np.ndarray:
    t = np.atleast_1d(np.asarray(t, dtype=np.float64))
    return harmonic_design(t, model.nof, model.period) @ model.coeffs if model.valid else np.full(len(t), model.fill_value)
