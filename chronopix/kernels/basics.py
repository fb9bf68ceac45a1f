"""Robust statistics and time-axis helpers."""

from __future__ import annotations

import numpy as np

DAY = 86400.0
MAD_SCALE = 1.4826


def finite(x) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    return x[np.isfinite(x)]


def nanmean(x) -> float:
    f = finite(x)
    return float(f.mean()) if f.size else float("nan")


def nanmedian(x) -> float:
    f = finite(x)
    return float(np.median(f)) if f.size else float("nan")


def mad_std(x) -> float:
    """Scaled median absolute deviation; 0 without finite values, never below 1.4826e-12 otherwise."""
    f = finite(x)
    return MAD_SCALE * max(float(np.median(np.abs(f - np.median(f)))), 1e-12) if f.size else 0.0


def robust_scale(x, floor: float) -> float:
    """Scaled MAD, or the population deviation where that is not above floor."""
    f = finite(x)
    s = MAD_SCALE * float(np.median(np.abs(f - np.median(f)))) if f.size else float("nan")
    if not np.isfinite(s) or s <= floor:
        s = float(np.sqrt(((f - f.mean()) ** 2).sum() / max(len(np.atleast_1d(x)), 1))) if f.size else 0.0
    return s


def days_to_seconds(t, target: float) -> tuple[np.ndarray, float]:
    """Axes that span at most 10 000 around targets within 100 000 are days, and become seconds; others are seconds."""
    t = np.asarray(t, dtype=np.float64)
    f = finite(t)
    if f.size and np.isfinite(target) and f.max() - f.min() <= 10_000.0 and abs(target) <= 100_000.0:
        return t * DAY, target * DAY
    return t, target


def top_frequency(t_rel) -> float:
    """Half the inverse of the median positive step of the time axis."""
    t = np.sort(np.asarray(t_rel, dtype=np.float64))
    steps = np.diff(t)
    steps = steps[steps > 0]
    step = float(np.median(steps)) if steps.size else (t[-1] - t[0]) / len(t)
    return 0.5 / max(step, 1e-12)
