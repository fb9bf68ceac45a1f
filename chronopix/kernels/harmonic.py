"""Harmonic models of one pixel: several bands together, or one band with steps or with outlier removal.

Times are seconds, frequencies Hz. The callers convert day axes, so that no model guesses units twice.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..config import HarmonicConfig
from . import ridge, spectrum, steps
from .basics import mad_std, nanmean, nanmedian, robust_scale, top_frequency

REFLECTANCE = 10_000.0


@dataclass
class VectorFit:
    valid: bool = False
    n_bands: int = 0
    freqs: np.ndarray = field(default_factory=lambda: np.empty(0))
    t_min: float = 0.0
    t_rel_mean: float = 0.0
    centers: np.ndarray = field(default_factory=lambda: np.empty(0))
    scales: np.ndarray = field(default_factory=lambda: np.empty(0))
    theta: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    include_trend: bool = True
    rows: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=int))


def normalise(y: np.ndarray, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """Centres and scales of each band."""
    if mode == "reflectance":
        return np.zeros(y.shape[1]), np.full(y.shape[1], REFLECTANCE)
    centre = np.array([nanmedian(c) for c in y.T])
    centre = np.where(np.isfinite(centre), centre, [nanmean(c) for c in y.T])
    if mode == "centered_reflectance":
        return centre, np.full(y.shape[1], REFLECTANCE)
    return centre, np.maximum([robust_scale(c, 1e-6) for c in y.T], 1e-6)


def _once(t: np.ndarray, y: np.ndarray, rows: np.ndarray, c: HarmonicConfig):
    """One fit on the given rows: (model, design, normalised observations), or None."""
    if len(rows) < max(c.min_obs, 3):
        return None
    start = t[rows].min()
    rel = t[rows] - start
    if not (np.isfinite(rel).all() and rel.max() > 0):
        return None
    centre, scale = normalise(y[rows], c.normalization_mode)
    z = (y[rows] - centre) / scale
    fmax = top_frequency(rel)
    f, p = spectrum.power(rel, z, c.modes, method=c.spectrum)
    if not f.size:
        return None
    wanted = spectrum.preferred_frequencies(c.preferred_periods_days)
    free = spectrum.phenology(f, p, fmax, wanted, c.preferred_top_k, c.ignore_dc_hz)
    freqs = spectrum.select_frequencies(f, p, fmax, c.mode, wanted, c)
    if not freqs.size:
        return None
    x = ridge.design(rel, freqs, c.include_trend)
    penalty = ridge.tiered_penalty(freqs, c.ridge_lam, c.lambda_high, c.low_freq_period_days, c.freq_weight, c.include_trend, free=free)
    w = np.ones(len(rows))
    system = ridge.MultiRidge(x, z, penalty, c.multiband_shrinkage)
    theta = system.solve()
    if theta is None:
        return None
    delta = threshold_floor(c)
    for _ in range(min(max(c.huber_iters, 1), 5)):
        e = np.sqrt(((z - x @ theta) ** 2).mean(1))
        w = np.maximum(0.5 * w + 0.5 * np.where(e <= delta, 1.0, delta / (e + 1e-12)), 0.03)
        again = system.solve(w)
        theta = theta if again is None else again
    return VectorFit(True, y.shape[1], freqs, float(start), float(rel.mean()), centre, scale, theta, c.include_trend, rows), x, z


def threshold_floor(c: HarmonicConfig) -> float:
    return max(c.huber_delta, 1e-6) if c.normalization_mode == "reflectance" else max(c.huber_delta, 1.5)


def fit_vector(t_sec, y, c: HarmonicConfig) -> VectorFit:
    """All bands on the dates where each is finite. y: (times, bands). With joint_outlier, dates that miss by far are
    dropped and the fit starts anew, up to outlier_reject_iters times."""
    t, y = np.asarray(t_sec, dtype=np.float64), np.asarray(y, dtype=np.float64)
    none = VectorFit(n_bands=y.shape[1] if y.ndim == 2 else 0, include_trend=c.include_trend)
    if not t.size or not none.n_bands or len(y) != len(t):
        return none
    rows = np.flatnonzero(np.isfinite(t) & np.isfinite(y).all(1))
    passes = min(c.outlier_reject_iters, 5) if c.joint_outlier else 0
    for left in range(passes, -1, -1):
        fitted = _once(t, y, rows, c)
        if fitted is None:
            return none
        model, x, z = fitted
        if not left:
            return model
        rms = np.sqrt(((z - x @ model.theta) ** 2).mean(1))
        limit = max(nanmedian(rms) + max(c.outlier_reject_sigma, 0.0) * robust_scale(rms, 1e-12), threshold_floor(c))
        far = np.flatnonzero(rms > limit)
        far = far[np.argsort(-rms[far], kind="stable")]
        removable = len(rows) - min(max(c.min_obs, x.shape[1] + 2), len(rows))
        n = min(len(far), removable, max(1, int(np.ceil(len(rows) * c.outlier_reject_max_fraction))))
        if not n:
            return model
        rows = np.delete(rows, far[:n])
    return none


def predict_vector(m: VectorFit, t_sec) -> np.ndarray:
    """(times, bands); NaN where there is no model."""
    t = np.atleast_1d(np.asarray(t_sec, dtype=np.float64))
    if not m.valid:
        return np.full((len(t), m.n_bands), np.nan)
    x = ridge.design(t - m.t_min, m.freqs, m.include_trend, t_mean=m.t_rel_mean)
    return m.centers + (x @ m.theta) * m.scales


@dataclass
class ScalarFit:
    valid: bool
    fill_value: float
    freqs: np.ndarray = field(default_factory=lambda: np.empty(0))
    beta: np.ndarray = field(default_factory=lambda: np.empty(0))
    t_min: float = 0.0
    t_rel_mean: float = 0.0
    include_trend: bool = True
    y_scale: float = 1.0


def _valid_series(t_sec, y) -> tuple[np.ndarray, np.ndarray]:
    t, y = np.asarray(t_sec, dtype=np.float64), np.asarray(y, dtype=np.float64)
    ok = np.isfinite(t) & np.isfinite(y)
    return t[ok], y[ok]


def _series_frequencies(rel, y, c: HarmonicConfig, mode: str) -> np.ndarray:
    f, p = spectrum.power(rel, y, c.modes, REFLECTANCE, c.spectrum)
    return spectrum.select_frequencies(f, p, top_frequency(rel), mode, spectrum.preferred_frequencies(c.preferred_periods_days), c)


def fit_scalar(t_sec, y, c: HarmonicConfig, shared=None) -> ScalarFit:
    """Huber ridge of one band, repeated without observations beyond outlier_sigma deviations. Knows no mode `all`."""
    t, v = _valid_series(t_sec, y)
    if len(t) < max(c.min_obs, 3):
        return ScalarFit(False, nanmean(y), include_trend=c.include_trend)
    rel = t - t.min()
    fill = nanmean(v)
    if not rel.max() > 0:
        return ScalarFit(False, fill, t_rel_mean=float(rel.mean()), include_trend=c.include_trend)
    if shared is None:
        freqs = _series_frequencies(rel, v, c, c.mode if c.mode in ("preferred", "hybrid") else "spectral")
    else:
        freqs = np.array([f for f in shared if np.isfinite(f) and c.ignore_dc_hz < f <= top_frequency(rel)])
    diagonal = ridge.ridge_diagonal(freqs, c.freq_weight, c.include_trend)
    run = lambda tt, yy: ridge.robust_ridge(ridge.design(tt, freqs, c.include_trend), yy, c.ridge_lam, diagonal, c.huber_iters, c.huber_delta)
    now_t, now_y, beta = rel, v / REFLECTANCE, None
    for _ in range(min(len(rel), 50) if c.outlier_sigma > 0 else 0):
        if len(now_y) < max(len(diagonal), c.min_obs):
            break
        beta, fitted = run(now_t, now_y)
        miss = now_y - fitted
        keep = np.abs(miss) <= c.outlier_sigma * max(mad_std(miss), 1e-12)
        if keep.all():
            break
        now_t, now_y = now_t[keep], now_y[keep]
    if beta is None:
        beta, _ = run(rel, v / REFLECTANCE)
    return ScalarFit(True, fill, freqs, beta, float(t.min()), float(rel.mean()), c.include_trend, REFLECTANCE)


def predict_scalar(m: ScalarFit, t_sec) -> np.ndarray:
    t = np.atleast_1d(np.asarray(t_sec, dtype=np.float64))
    if not m.valid:
        return np.full(len(t), m.fill_value)
    return ridge.design(t - m.t_min, m.freqs, m.include_trend, t_mean=m.t_rel_mean) @ m.beta * m.y_scale


def _alternate(t, rel, y, freqs, c: HarmonicConfig, centred: bool, euclidean: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ridge for the waves and fused lasso for the steps, in turn, until both settle."""
    x = ridge.design(rel, freqs, c.include_trend)
    penalty = ridge.tiered_penalty(freqs, c.ridge_lam, c.lambda_high, c.low_freq_period_days, c.freq_weight, c.include_trend)
    waves = lambda v: (lambda b: np.zeros(x.shape[1]) if b is None else b)(ridge.tiered_solution(x, v, penalty))
    weights = steps.difference_weights(t, c.step_dt_weighting)
    beta, u = waves(y), np.zeros(len(y))
    for _ in range(c.max_outer_iter):
        old_beta, old_u = beta, u
        u = steps.fused_lasso(y - x @ beta, c.lambda_step, weights)
        if centred:
            u = u - u.mean()
        beta = waves(y - u)
        base = max(np.linalg.norm(old_beta) + np.linalg.norm(old_u), 1e-12)
        moved = np.r_[beta - old_beta, u - old_u]
        if (np.linalg.norm(moved) if euclidean else np.abs(moved).sum()) / base < c.outer_tol:
            break
    return beta, u


def fit_steps(t_sec, y, freqs, c: HarmonicConfig) -> ScalarFit | None:
    """Waves at given frequencies plus steps, without scaling; the steps are not part of the model that comes back."""
    t, v = _valid_series(t_sec, y)
    if len(t) < max(c.min_obs, 3):
        return None
    rel = t - t.min()
    freqs = np.asarray(freqs, dtype=np.float64)
    beta, _ = _alternate(t, rel, v, freqs, c, centred=False, euclidean=False)
    return ScalarFit(True, nanmean(v), freqs, beta, float(t.min()), float(rel.mean()), c.include_trend)


def predict_pixel(t_sec, y, target: float, c: HarmonicConfig) -> tuple[float, int]:
    """One band with waves and steps: (prediction, number of frequencies). Without enough dates, the mean and 0.

    The step at the target is that of the last date not after it, or the first date's.
    """
    t, v = _valid_series(t_sec, y)
    if len(t) < max(c.min_obs, 3):
        return nanmean(y), 0
    rel = t - t.min()
    if not rel.max() > 0:
        return nanmean(v), 0
    freqs = _series_frequencies(rel, v, c, c.mode)
    beta, u = _alternate(t, rel, v / REFLECTANCE, freqs, c, centred=True, euclidean=True)
    x = ridge.design([target - t.min()], freqs, c.include_trend, t_mean=float(rel.mean()))
    at = max(int(np.searchsorted(t, target, side="right")) - 1, 0)
    return float((x @ beta)[0] + u[at]) * REFLECTANCE, len(freqs)
