"""Design matrices, penalties and (robust) ridge solutions."""

from __future__ import annotations

import numpy as np

from .basics import DAY


def design(t, freqs, trend: bool = True, dc: bool = True, t_mean: float | None = None) -> np.ndarray:
    """Columns 1, t - mean, then cos and sin of each frequency."""
    t = np.asarray(t, dtype=np.float64)
    freqs = np.asarray(freqs, dtype=np.float64)
    parts = []
    if dc:
        parts.append(np.ones((len(t), 1)))
    if trend:
        parts.append((t - (t.mean() if t_mean is None else t_mean))[:, None])
    angle = 2 * np.pi * np.outer(t, freqs)
    waves = np.empty((len(t), 2 * len(freqs)))
    waves[:, 0::2], waves[:, 1::2] = np.cos(angle), np.sin(angle)
    return np.hstack([*parts, waves]) if parts or len(freqs) else np.empty((len(t), 0))


def frequency_penalty(freqs, weight: float) -> np.ndarray:
    """sqrt(1 + weight log2(f / lowest)), 1 up to the lowest positive frequency."""
    f = np.asarray(freqs, dtype=np.float64)
    good = f[np.isfinite(f) & (f > 0)]
    if not good.size:
        return np.ones(len(f))
    ratio = np.where(np.isfinite(f) & (f > good.min()), f / good.min(), 1.0)
    return np.sqrt(1 + max(weight, 0.0) * np.log2(ratio))


def ridge_diagonal(freqs, weight: float, trend: bool = True, dc: bool = True) -> np.ndarray:
    return np.concatenate([np.ones(int(dc) + int(trend)), np.repeat(frequency_penalty(freqs, weight), 2)])


def high_tier(freqs, days: float) -> np.ndarray:
    f = np.asarray(freqs, dtype=np.float64)
    ok = np.isfinite(f) & (f > 0)
    return ok & (1 / (np.where(ok, f, 1.0) * DAY) < days)


def tiered_penalty(freqs, lam: float, lam_high: float, days: float, weight: float, trend: bool = True, dc: bool = True, free=()) -> np.ndarray:
    """lam times the squared ridge diagonal, more for short periods, nothing for free frequencies."""
    freqs = np.asarray(freqs, dtype=np.float64)
    out = lam * ridge_diagonal(freqs, weight, trend, dc) ** 2
    head = int(dc) + int(trend)
    if lam_high > lam:
        out[head:] += (lam_high - lam) * np.repeat(high_tier(freqs, days), 2)
    out = np.maximum(out, 0.0)
    if len(free):
        free = np.asarray(free, dtype=np.float64)
        same = (np.abs(freqs[:, None] - free) <= 1e-10 * np.maximum(np.abs(free), 1e-30)).any(1)
        out[head:][np.repeat(same, 2)] = 0.0
    return out


def solve(a: np.ndarray, b: np.ndarray, pivot: float = 1e-14) -> np.ndarray | None:
    """Gauss elimination with partial pivoting; None if a pivot falls below the absolute limit."""
    a, b = np.array(a, dtype=np.float64), np.array(b, dtype=np.float64)
    flat = b.ndim == 1
    b = b[:, None] if flat else b
    n = len(a)
    for k in range(n):
        best = k + int(np.argmax(np.abs(a[k:, k])))
        if not abs(a[best, k]) >= pivot:
            return None
        if best != k:
            a[[k, best]], b[[k, best]] = a[[best, k]], b[[best, k]]
        factor = a[k + 1 :, k] / a[k, k]
        a[k + 1 :, k:] -= np.outer(factor, a[k, k:])
        b[k + 1 :] -= np.outer(factor, b[k])
    x = np.zeros_like(b)
    for k in range(n - 1, -1, -1):
        x[k] = (b[k] - a[k, k + 1 :] @ x[k + 1 :]) / a[k, k]
    return x[:, 0] if flat else x


def cholesky(a: np.ndarray) -> np.ndarray | None:
    """The lower factor, or None if a is not positive definite (a pivot of 1e-14 or less)."""
    try:
        factor = np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        return None
    d = np.diag(factor)
    return factor if np.isfinite(d).all() and (d * d > 1e-14).all() else None


def positive_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Through the Cholesky factor; if there is none, once more with 1e-6 on the diagonal."""
    for jitter in (0.0, 1e-6):
        system = a + jitter * np.eye(len(a)) if jitter else a
        if cholesky(system) is not None:
            return np.linalg.solve(system, b)
    return None


def normal_solution(x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    """Least squares by the normal equations; None with fewer rows than columns or a singular system."""
    return None if x.shape[0] < x.shape[1] else solve(x.T @ x, x.T @ y)


def ridge_solution(x: np.ndarray, y: np.ndarray, lam: float, diagonal: np.ndarray, w: np.ndarray | None = None) -> np.ndarray | None:
    """Weighted ridge with penalty lam * diagonal**2; plain (weighted) least squares where lam is not positive."""
    w = np.ones(len(y)) if w is None else np.maximum(w, 0.0)
    xw = x * w[:, None]
    if lam <= 0:
        return None if x.shape[0] < x.shape[1] else solve(xw.T @ x, xw.T @ y)
    return solve(xw.T @ x + np.diag(lam * diagonal**2), xw.T @ y)


def tiered_solution(x, y, penalty: np.ndarray) -> np.ndarray | None:
    return solve(x.T @ x + np.diag(penalty), x.T @ y)


def huber_weights(r, delta: float) -> np.ndarray:
    a = np.abs(np.asarray(r, dtype=np.float64))
    d = max(delta, 1e-8)
    return np.where(a <= d, 1.0, d / np.maximum(a, 1e-300))


def robust_ridge(x, y, lam: float, diagonal, iters: int, delta: float) -> tuple[np.ndarray, np.ndarray]:
    """Ridge, then iters + 1 rounds of Huber weights; a round without a solution keeps the one before."""
    beta = ridge_solution(x, y, lam, diagonal)
    beta = np.zeros(x.shape[1]) if beta is None else beta
    for _ in range(iters + 1):
        again = ridge_solution(x, y, lam, diagonal, huber_weights(y - x @ beta, delta))
        beta = beta if again is None else again
    return beta, x @ beta


class MultiRidge:
    """Ridge of all bands at once, for several weightings of the same rows.

    With shrinkage, the bands' mean is solved with the penalty alone and what bands differ from it by with the shrinkage on top
    (none on the constant). The normal equations of weights near 1 are those without weights, corrected by the other rows.
    """

    def __init__(self, x: np.ndarray, z: np.ndarray, penalty: np.ndarray, shrink: float, dc: bool = True):
        self.x, self.z, self.shrink = x, z, shrink if z.shape[1] > 1 else 0.0
        self.plain, self.rhs = x.T @ x, x.T @ z
        self.diagonal = np.maximum(penalty, 1e-12)
        self.extra = np.full(x.shape[1], max(shrink, 0.0))
        if dc:
            self.extra[:1] = 0.0

    def solve(self, w: np.ndarray | None = None) -> np.ndarray | None:
        a, rhs = self.plain.copy(), self.rhs
        if w is not None:
            w = np.where(np.isfinite(w), np.maximum(w, 0.0), 0.0)
            other = np.flatnonzero(w != 1.0)
            if len(other) > len(w) // 2:
                xw = self.x * w[:, None]
                a, rhs = xw.T @ self.x, xw.T @ self.z
            elif len(other):
                some = self.x[other]
                xw = some * (w[other] - 1.0)[:, None]
                a += xw.T @ some
                rhs = rhs + xw.T @ self.z[other]
        at = np.arange(len(a))
        a[at, at] += self.diagonal
        if self.shrink <= 0:
            return positive_solve(a, rhs)
        if cholesky(a) is None:
            a[at, at] += 1e-6
            if cholesky(a) is None:
                return None
        # what is added to the diagonal keeps the system positive definite
        mean = rhs.mean(1, keepdims=True)
        common = np.linalg.solve(a, mean)
        a[at, at] += self.extra
        return common + np.linalg.solve(a, rhs - mean)

