"""Power spectra of irregular samples, and the choice of frequencies."""

from __future__ import annotations

import numpy as np

from .basics import DAY, MAD_SCALE

OVERSAMPLE, WIDTH, BETA = 2.0, 8, 10.0


def matched_beta(width: int, oversample: float) -> float:
    """The Kaiser-Bessel parameter whose transform is small wherever a grid so many times as fine as the modes need folds."""
    return np.pi * width * (1 - 1 / (2 * oversample))


# Coefficients of the usual two-branch polynomial approximation of the Bessel function I0, lowest order first.
I0_SMALL = (1.0, 3.5156229, 3.0899424, 1.2067492, 0.2659732, 0.0360768, 0.0045813)
I0_LARGE = (0.39894228, 0.01328592, 0.00225319, -0.00157565, 0.00916281, -0.02057706, 0.02635537, -0.01647633, 0.00392377)


def next_even(n: int) -> int:
    return n + n % 2


def next_power_of_two(n: int) -> int:
    return 1 << max(1, (int(n) - 1).bit_length())


def bessel_i0(x) -> np.ndarray:
    x = np.abs(np.asarray(x, dtype=np.float64))
    small = np.polynomial.polynomial.polyval((np.minimum(x, 3.75) / 3.75) ** 2, I0_SMALL)
    large = np.maximum(x, 3.75)
    return np.where(x < 3.75, small, np.exp(large) / np.sqrt(large) * np.polynomial.polynomial.polyval(3.75 / large, I0_LARGE))


def kaiser_bessel(x, beta: float = BETA) -> np.ndarray:
    x = np.abs(np.asarray(x, dtype=np.float64))
    return np.where(x > 1, 0.0, bessel_i0(beta * np.sqrt(np.maximum(0, 1 - x * x))) / bessel_i0(beta))


def _phase(t_rel: np.ndarray) -> tuple[np.ndarray, float]:
    span = float(t_rel.max() - t_rel.min()) if t_rel.size else 0.0
    return (2 * np.pi * (t_rel - t_rel.min()) / span - np.pi if span > 0 else np.zeros_like(t_rel)), span


def direct_coefficients(t_rel: np.ndarray, y: np.ndarray, modes: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies k / span and sums over y exp(-i k x), for k below half the even number of modes. y: (times, bands)."""
    x, span = _phase(t_rel)
    k = np.arange(next_even(modes) // 2)
    return k / span, np.exp(-1j * np.outer(k, x)) @ y


def gridded_coefficients(t_rel: np.ndarray, y: np.ndarray, modes: int, oversample: float = OVERSAMPLE, width: int = WIDTH, beta: float | None = None):
    """The same through a spread onto a regular grid with a Kaiser-Bessel kernel, an FFT and a division by the kernel's.

    Without beta it is the grid's (18.8 for twice as many points as modes). The fixed 10 leaves errors of over a ten-thousandth of the largest power.
    """
    x, span = _phase(t_rel)
    m = next_even(modes)
    nf = next_power_of_two(int(np.ceil(m * max(oversample, 1.25))))
    half = max(width, 2) / 2
    beta = matched_beta(max(width, 2), nf / m) if beta is None else beta
    offsets = np.arange(-width, width + 1)
    u = x * nf / (2 * np.pi)
    at = (np.trunc(u + np.copysign(0.5, u))[:, None] + offsets).astype(np.int64)
    gap = u[:, None] - at
    w = np.where(np.abs(gap) <= half, kaiser_bessel(gap / half, beta), 0.0)
    grid = np.zeros((nf, y.shape[1]))
    np.add.at(grid, at.ravel() % nf, (w[:, :, None] * y[:, None, :]).reshape(-1, y.shape[1]))
    kernel = np.zeros(nf)
    np.add.at(kernel, offsets % nf, np.where(np.abs(offsets) <= half, kaiser_bessel(offsets / half, beta), 0.0))
    hat = np.fft.fft(kernel)[: m // 2]
    raw = np.fft.fft(grid, axis=0)[: m // 2]
    live = np.abs(hat) ** 2 > 1e-24
    return np.arange(m // 2) / span, np.where(live[:, None], raw / np.where(live, hat, 1)[:, None], 0)


def power(t_rel, y, modes: int, scale: float = 1.0, method: str = "gridded") -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and power; with several bands, the sum of their powers. A time axis without extent gives one zero."""
    t_rel = np.asarray(t_rel, dtype=np.float64)
    y = np.asarray(y, dtype=np.float64)
    y = y[:, None] if y.ndim == 1 else y
    if not t_rel.size or len(y) != t_rel.size:
        return np.empty(0), np.empty(0)
    if not t_rel.max() > t_rel.min():
        return np.zeros(1), np.zeros(1)
    y = np.where(np.isfinite(y), y, 0.0) / scale
    f, c = (gridded_coefficients if method == "gridded" else direct_coefficients)(t_rel, y, modes)
    return f, (np.abs(c) ** 2).sum(1)


def joint_spectrum(years, y, n: int = 480, low: float = 0.05, high: float = 6.0) -> tuple[np.ndarray, np.ndarray]:
    """V8: (cycles a year, power / n of each band) over n frequencies, of bands less their median over their scaled MAD."""
    years, y = np.asarray(years, dtype=np.float64), np.asarray(y, dtype=np.float64)
    cycles = np.linspace(low, high, n)
    middle = np.median(y, 0)
    scale = MAD_SCALE * np.median(np.abs(y - middle), 0)
    z = (y - middle) / np.where(np.isfinite(scale) & (scale >= 1e-6), scale, 1.0)
    return cycles, np.abs(np.exp(-2j * np.pi * np.outer(cycles, years)) @ z) ** 2 / max(len(years), 1)


def preferred_frequencies(periods: str) -> list[float]:
    """'365.25, 182.6' (days) to frequencies in Hz; what is no positive number is left out."""
    out = []
    for part in periods.split(","):
        try:
            p = float(part)
        except ValueError:
            continue
        if np.isfinite(p) and p > 0:
            out.append(1 / (p * DAY))
    return out


def parabola(f: np.ndarray, p: np.ndarray, i: int) -> float:
    """Where the parabola through a bin and its neighbours has its extreme."""
    if i == 0 or i >= len(p) - 1:
        return float(f[i])
    bend = p[i - 1] - 2 * p[i] + p[i + 1]
    return float(f[i]) if bend == 0 else float(f[i] + 0.5 * (p[i - 1] - p[i + 1]) / bend * (f[i + 1] - f[i]))


def upper_median_spacing(f: np.ndarray) -> float | None:
    d = np.diff(f)
    d = np.sort(d[np.isfinite(d) & (d > 0)])
    return float(d[len(d) // 2]) if d.size else None


def snap(target: float, f: np.ndarray, p: np.ndarray) -> float:
    """The bin within one spacing of target with the most power times sinc squared of its distance."""
    df = upper_median_spacing(f)
    if not np.isfinite(target) or target <= 0 or df is None:
        return target
    near = np.flatnonzero(np.isfinite(f) & np.isfinite(p) & (f > 0) & (np.abs(f - target) <= df))
    if not near.size:
        return target
    return float(f[near[np.argmax(p[near] * np.sinc(np.abs(f[near] - target) / df) ** 2)]])


def strongest(f: np.ndarray, p: np.ndarray, k: int, share: float, low: float, high: float) -> np.ndarray:
    """Bins by falling power until k are taken or their power reaches the share of all; one at least, if there is any."""
    if not np.isfinite(high) or high <= 0:
        high = max([1.0, *f[np.isfinite(f)]])
    at = np.flatnonzero(np.isfinite(f) & np.isfinite(p) & (f > max(low, 0.0)) & (f <= high))
    at = at[np.argsort(-p[at], kind="stable")]
    if not at.size:
        return at
    reached = np.cumsum(p[at]) >= np.clip(share, 0, 1) * p[at].sum()
    first = int(np.argmax(reached)) + 1 if reached.any() else len(at)
    return at[: max(1, min(first, max(k, 1)))]


def phenology(f, p, fmax: float, preferred: list[float], k: int, low: float) -> list[float]:
    inside = lambda x: np.isfinite(x) and low < x <= fmax
    snapped = [snap(x, f, p) for x in [x for x in preferred if inside(x)][:k]]
    return [x for x in snapped if inside(x)]


def merge_near(sorted_f, tol: float) -> list[float]:
    """Neighbours within the relative tolerance become their mean, one after the other."""
    out: list[float] = []
    for x in sorted_f:
        if out and abs(x - out[-1]) / max(out[-1], 1e-12) <= max(tol, 0.0):
            out[-1] = 0.5 * (out[-1] + x)
        else:
            out.append(float(x))
    return out


def select_frequencies(f, p, fmax: float, mode: str, preferred: list[float], config) -> np.ndarray:
    """Modes: all grid bins plus snapped preferred ones; preferred; hybrid (preferred and strongest); else strongest."""
    f, p = np.asarray(f, dtype=np.float64), np.asarray(p, dtype=np.float64)
    low = config.ignore_dc_hz
    chosen: list[float] = []
    if mode == "all":
        chosen += f[np.isfinite(f) & (f > low) & (f <= fmax)].tolist()
    if mode in ("all", "preferred", "hybrid") and preferred:
        chosen += phenology(f, p, fmax, preferred, config.preferred_top_k, low)
    if mode in ("spectral", "hybrid"):
        at = strongest(f, p, config.spectral_top_k or config.num_peaks, config.power_cum, low, fmax)
        chosen += [parabola(f, p, int(i)) if config.refine_peaks else float(f[i]) for i in at]
    chosen = sorted(x for x in chosen if np.isfinite(x) and low < x <= fmax)
    if mode != "all":
        return np.array(merge_near(chosen, config.spectral_merge_tol))
    kept: list[float] = []
    for x in chosen:
        if not kept or x - kept[-1] > 1e-18:
            kept.append(x)
    return np.array(kept)
