"""Several bands with waves of their own and steps in common, by turns of ridge and group fused lasso."""

from __future__ import annotations

import numpy as np

from ..config import HarmonicConfig
from . import ridge, spectrum, steps
from .basics import MAD_SCALE, nanmedian, top_frequency
from .harmonic import REFLECTANCE


def _peaks(f, p, fmax: float, c: HarmonicConfig) -> list[float]:
    """The strongest bins by falling power, refined, within the limits."""
    at = spectrum.strongest(f, p, c.num_peaks, c.power_cum, c.ignore_dc_hz, fmax)
    found = [spectrum.parabola(f, p, int(i)) if c.refine_peaks else float(f[i]) for i in at]
    return [x for x in found if np.isfinite(x) and c.ignore_dc_hz < x <= fmax]


def private_frequencies(f, p, shared: list[float], fmax: float, c: HarmonicConfig) -> list[float]:
    """A band's own peaks, sorted: private_top_k_per_band at most, none within twice the merging tolerance of a shared one or of each other."""
    near = lambda x, others: any(o > 0 and abs(x - o) / max(o, 1e-12) <= 2 * max(c.spectral_merge_tol, 0.0) for o in others)
    own: list[float] = []
    for x in _peaks(f, p, fmax, c):
        if len(own) >= c.private_top_k_per_band:
            break
        if not near(x, shared) and not near(x, own):
            own.append(x)
    return sorted(own)


def mixed_penalty(freqs, shared, private, c: HarmonicConfig) -> np.ndarray:
    """The squared ridge diagonal by tiers; columns take the shared frequencies' penalties first, then the private ones', which count more."""
    head = 1 + int(c.include_trend)
    diagonal = np.ones(head + 2 * len(freqs))
    waves = np.concatenate([ridge.frequency_penalty(shared, c.freq_weight), ridge.frequency_penalty(private, c.freq_weight) * c.private_freq_penalty_mult])
    filled = np.repeat(waves, 2)[: len(diagonal) - head]
    diagonal[head : head + len(filled)] = filled
    out = c.ridge_lam * diagonal**2
    if c.lambda_high > c.ridge_lam:
        out[head:] += (c.lambda_high - c.ridge_lam) * np.repeat(ridge.high_tier(freqs, c.low_freq_period_days), 2)
    return np.maximum(out, 0.0)


def predict_joint(t_sec, y, target: float, c: HarmonicConfig) -> np.ndarray:
    """A value of each band at the target; NaN where there is no model. y: (times, bands).

    Frequencies are the peaks of the median of the bands' spectra, and each band's own; dates that all bands have are used, less
    those whose residuals stand out jointly; the bands' steps change together, sum to zero, and the target has those of the last
    date not after it.
    """
    t, y = np.asarray(t_sec, dtype=np.float64), np.asarray(y, dtype=np.float64)
    out = np.full(y.shape[1], np.nan)
    least = max(c.min_obs, 3)
    spectra = {}
    for b, v in enumerate(y.T):
        ok = np.isfinite(t) & np.isfinite(v)
        if ok.sum() >= least:
            spectra[b] = (t[ok], *spectrum.power(t[ok] - t[ok].min(), v[ok], c.modes, REFLECTANCE, c.spectrum))
    if not spectra:
        return out
    f = next(iter(spectra.values()))[1]
    power = np.array([s[2] for s in spectra.values() if len(s[2]) == len(f)])
    fmax = top_frequency(np.concatenate([s[0] for s in spectra.values()]))
    shared = spectrum.merge_near(sorted(_peaks(f, np.median(power, axis=0), fmax, c)), c.spectral_merge_tol)
    rows = np.flatnonzero(np.isfinite(t) & np.isfinite(y).all(1))
    if not shared or len(rows) < least:
        return out
    bands = list(spectra)
    private = [private_frequencies(spectra[b][1], spectra[b][2], shared, fmax, c) for b in bands]
    freqs = [spectrum.merge_near(sorted(shared + own), c.spectral_merge_tol) for own in private]
    penalties = [mixed_penalty(fs, shared, own, c) for fs, own in zip(freqs, private, strict=True)]
    z = y[rows][:, bands] / REFLECTANCE

    def designs(times: np.ndarray) -> list[np.ndarray]:
        return [ridge.design(times - times.min(), fs, c.include_trend) for fs in freqs]

    def solve(xs: list[np.ndarray], values: np.ndarray) -> list[np.ndarray]:
        found = [ridge.tiered_solution(x, v, p) for x, v, p in zip(xs, values.T, penalties, strict=True)]
        return [np.zeros(x.shape[1]) if b is None else b for x, b in zip(xs, found, strict=True)]

    waves = lambda xs, betas: np.column_stack([x @ b for x, b in zip(xs, betas, strict=True)])
    if c.joint_outlier and len(rows) >= max(c.min_obs, 3 * len(bands), 2):
        xs = designs(t[rows])
        miss = z - waves(xs, solve(xs, z))
        sigma = [MAD_SCALE * nanmedian(np.abs(m - nanmedian(m))) for m in miss.T]
        keep = steps.joint_outliers(miss, sigma, c.joint_outlier_sigma)
        if keep.sum() >= least:
            rows, z = rows[keep], z[keep]
    now = t[rows]
    xs = designs(now)
    weights = steps.difference_weights(now, c.step_dt_weighting)
    betas, u = solve(xs, z), np.zeros_like(z)
    for _ in range(c.max_outer_iter):
        before, u_before = np.concatenate(betas), u
        u = steps.group_fused_lasso(z - waves(xs, betas), c.lambda_step, weights, c.admm_rho, c.admm_max_iter, c.admm_tol)
        u = u - u.mean(0)
        betas = solve(xs, z - u)
        moved = np.r_[np.concatenate(betas) - before, (u - u_before).ravel()]
        if np.linalg.norm(moved) / max(np.linalg.norm(np.r_[before, u_before.ravel()]), 1e-12) < c.outer_tol:
            break
    at = max(int(np.searchsorted(now, target, side="right")) - 1, 0)
    rel = now - now.min()
    for k, b in enumerate(bands):
        x = ridge.design([target - now.min()], freqs[k], c.include_trend, t_mean=float(rel.mean()))
        out[b] = ((x @ betas[k])[0] + u[at, k]) * REFLECTANCE
    return out
