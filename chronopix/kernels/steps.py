"""Piecewise-constant terms: fused lasso, its group form, and outliers of several bands."""

from __future__ import annotations

import numpy as np

from .basics import DAY, MAD_SCALE, nanmedian


def difference_weights(t_sec, by_gap: bool) -> np.ndarray:
    t = np.asarray(t_sec, dtype=np.float64)
    return 1 / np.sqrt(np.maximum(np.diff(t) / DAY, 1.0)) if by_gap else np.ones(max(len(t) - 1, 0))


def transposed_difference(y: np.ndarray) -> np.ndarray:
    """D'y for the difference operator D along the first axis."""
    edge = np.zeros((1, *y.shape[1:]))
    return -np.diff(np.concatenate([edge, y, edge]), axis=0)


def fused_lasso(r, lam: float, weights) -> np.ndarray:
    """argmin 0.5 |r - u|^2 + lam sum w |u_{i+1} - u_i|.

    The running sum of u is the taut string through the tube of width lam w around the running sum of r, so a funnel of
    convex chains gives u exactly, in time linear in its length.
    """
    r = np.asarray(r, dtype=np.float64)
    n = len(r)
    if n <= 1 or lam <= 0:
        return r.copy()
    if lam > 1e6:
        return np.zeros(n)
    total = np.concatenate(([0.0], np.cumsum(r)))
    width = np.concatenate(([0.0], lam * np.asarray(weights, dtype=np.float64), [0.0]))
    upper, lower = (total + width).tolist(), (total - width).tolist()
    knots = [(0, 0.0)]
    top, bottom = [(0, 0.0)], [(0, 0.0)]  # chains from the last knot: least concave under, greatest convex over

    def slope(a: tuple, b: tuple) -> float:
        return (b[1] - a[1]) / (b[0] - a[0])

    i = 1
    while i <= n:
        up, low = (i, upper[i]), (i, lower[i])
        while len(top) > 1 and slope(top[-2], top[-1]) >= slope(top[-1], up):
            top.pop()
        top.append(up)
        while len(bottom) > 1 and slope(bottom[-2], bottom[-1]) <= slope(bottom[-1], low):
            bottom.pop()
        bottom.append(low)
        # the string touches a side where the two chains would cross
        while len(top) > 1 and len(bottom) > 1 and slope(top[0], top[1]) < slope(bottom[0], bottom[1]):
            if len(top) == 2 and top[1][0] == i:
                knots.append(bottom[1])
                del bottom[0]
                top = [bottom[0], up] if bottom[0][0] < i else [bottom[0]]
            else:
                knots.append(top[1])
                del top[0]
                bottom = [top[0], low] if top[0][0] < i else [top[0]]
        i += 1
    if knots[-1][0] < n:
        knots += bottom[1:] if len(bottom) > 1 else top[1:]
    at, height = np.array([k[0] for k in knots]), np.array([k[1] for k in knots])
    return np.repeat(np.diff(height) / np.diff(at), np.diff(at))


def tridiagonal(diag, off, rhs) -> np.ndarray:
    """Symmetric tridiagonal systems with several right-hand sides."""
    d, e = np.array(diag, dtype=np.float64), np.asarray(off, dtype=np.float64)
    x = np.array(rhs, dtype=np.float64)
    for i in range(1, len(d)):
        m = e[i - 1] / d[i - 1]
        d[i] -= m * e[i - 1]
        x[i] -= m * x[i - 1]
    x[-1] /= d[-1]
    for i in range(len(d) - 2, -1, -1):
        x[i] = (x[i] - e[i] * x[i + 1]) / d[i]
    return x


def group_fused_lasso(r, lam: float, weights, rho: float = 1.0, rounds: int = 80, tol: float = 1e-4) -> np.ndarray:
    """argmin 0.5 |R - U|^2 + lam sum w |U_{i+1} - U_i|_2 over rows, by ADMM on the differences."""
    r = np.asarray(r, dtype=np.float64)
    n = len(r)
    if n <= 1 or lam <= 0:
        return r.copy()
    if lam > 1e6:
        return np.zeros_like(r)
    limit = lam * np.asarray(weights, dtype=np.float64)
    if limit.min() >= 10 * np.linalg.norm(np.diff(r, axis=0), axis=1).max():
        return np.broadcast_to(r.mean(0), r.shape).copy()
    diag = 1 + rho * np.r_[1.0, np.full(n - 2, 2.0), 1.0]
    off = np.full(n - 1, -rho)
    v = dual = np.zeros((n - 1, r.shape[1]))
    u = r
    for _ in range(rounds):
        before = u
        u = tridiagonal(diag, off, r + rho * transposed_difference(v - dual))
        jumps = np.diff(u, axis=0)
        ahead = jumps + dual
        size = np.maximum(np.linalg.norm(ahead, axis=1, keepdims=True), 1e-30)
        v = ahead * np.maximum(0, 1 - limit[:, None] / rho / size)
        dual = ahead - v
        if max(np.abs(jumps - v).max(), np.abs(u - before).max()) < tol:
            break
    return u


def joint_outliers(residuals, sigma, k: float) -> np.ndarray:
    """True for rows to keep: their norm over sigma, in bands with a positive sigma, is at most median + k MAD."""
    r, s = np.asarray(residuals, dtype=np.float64), np.asarray(sigma, dtype=np.float64)
    bands = s > 0
    if not bands.any():
        return np.ones(len(r), dtype=bool)
    norm = np.sqrt(((r[:, bands] / s[bands]) ** 2).sum(1))
    if bands.sum() == 1:
        return norm <= k
    centre = nanmedian(norm)
    mad = MAD_SCALE * nanmedian(np.abs(norm - centre))
    return norm <= centre + k * mad if mad > 0 else np.isfinite(norm)
