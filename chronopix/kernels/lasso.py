"""LASSO harmonics with breaks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .basics import finite, nanmedian

YEAR = 365.25
LEAST = 6


def model_order(n: int) -> int:
    return 0 if n < 6 else 1 if n < 18 else 2 if n < 24 else 3


def soft_threshold(z: float, t: float) -> float:
    return z - t if z > t else z + t if z < -t else 0.0


def harmonics(t, order: int, mean: float) -> np.ndarray:
    """cos and sin of each order's yearly harmonic, then time less its mean in training; no constant."""
    t = np.asarray(t, dtype=np.float64)
    angle = 2 * np.pi / YEAR * np.outer(t, np.arange(1, order + 1))
    out = np.empty((len(t), 2 * order + 1))
    out[:, 0:-1:2], out[:, 1:-1:2], out[:, -1] = np.cos(angle), np.sin(angle), t - mean
    return out


def coordinate_descent(x, y, alpha: float, rounds: int = 1000, tol: float = 1e-12) -> tuple[np.ndarray, float]:
    """min |y - Xw - b|^2 / 2n + alpha |w|_1 by cyclic coordinate descent on centred columns: (w, b)."""
    n, p = x.shape
    centre, level = x.mean(0), y.mean()
    gram, reach = (x - centre).T @ (x - centre), (x - centre).T @ (y - level)
    w = np.zeros(p)
    for _ in range(rounds):
        change = 0.0
        for j in range(p):
            if gram[j, j] == 0:
                continue
            new = soft_threshold((reach[j] - gram[j] @ w) / n + gram[j, j] * w[j] / n, alpha) * n / gram[j, j]
            change = max(change, abs(new - w[j]))
            w[j] = new
        if change < tol:
            break
    return w, float(level - centre @ w)


@dataclass
class Segment:
    coef: np.ndarray
    intercept: float
    order: int
    rmse: float
    x_mean: float
    t_start: float
    t_end: float

    def predict(self, t) -> np.ndarray:
        return harmonics(np.atleast_1d(t), self.order, self.x_mean) @ self.coef + self.intercept


def fit_segment(t, y, alpha: float) -> Segment | None:
    t, y = np.asarray(t, dtype=np.float64), np.asarray(y, dtype=np.float64)
    ok = np.isfinite(y)
    t, y = t[ok], y[ok]
    order = model_order(len(y))
    if not order:
        return None
    mean = float(t.mean())
    x = harmonics(t, order, mean)
    coef, intercept = coordinate_descent(x, y, alpha)
    return Segment(coef, intercept, order, float(np.sqrt(((y - x @ coef - intercept) ** 2).mean())), mean, float(t[0]), float(t[-1]))


def fit_predict(t, y, target: float, alpha: float) -> tuple[float, int]:
    """(prediction, quality): quality is the model's order, 0 where a median stands in for too few observations."""
    segment = fit_segment(t, y, alpha)
    return (float(segment.predict(target)[0]), segment.order) if segment else (nanmedian(y), 0)


def breaks(segment: Segment, t, y) -> list[int]:
    """Six observations in a row that miss by over twice the segment's rmse make a break, five positions before the sixth."""
    t, y = np.asarray(t, dtype=np.float64), np.asarray(y, dtype=np.float64)
    out, row = [], 0
    miss = np.abs(y - segment.predict(t)) > 2 * segment.rmse
    for i in np.flatnonzero(np.isfinite(y)):
        row = row + 1 if miss[i] else 0
        if row == LEAST:
            out.append(max(int(i) - 5, 0))
            row = 0
    return out


def temporal_rmse(t, y, target_doy: float, n: int) -> float | None:
    """Population deviation of the n values nearest by day of year."""
    t, y = np.asarray(t, dtype=np.float64), np.asarray(y, dtype=np.float64)
    ok = np.isfinite(y)
    if ok.sum() < n:
        return None
    gap = np.abs(np.fmod(t[ok], YEAR) - np.fmod(target_doy, YEAR))
    gap = np.where(gap > YEAR / 2, YEAR - gap, gap)
    return float(np.std(finite(y)[np.argsort(gap, kind="stable")[:n]]))
