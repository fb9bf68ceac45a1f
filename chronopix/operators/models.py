"""Estimators over series: one Arrow batch of pixels at a time, numpy inside.

A series has a row per pixel: key columns, t (days, ascending), y (per date an array of bands, NULL where missing), and a
target (days). Results keep the keys; what a model can't say is NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Algorithm, HantsConfig, HarmonicConfig, LassoConfig
from ..kernels import hants, harmonic, joint, lasso
from ..kernels.basics import DAY


def arrays(t, y) -> tuple[np.ndarray, np.ndarray]:
    """Times and a (dates, bands) matrix with NaN for what is missing."""
    if isinstance(y, np.ndarray) and y.ndim == 2:  # as map_series() passes it
        return t, y
    return np.asarray(t, dtype=np.float64), np.array([np.asarray(row, dtype=np.float64) for row in y]).reshape(len(t), -1)


def _nullable(v) -> list:
    return [float(x) if np.isfinite(x) else None for x in np.atleast_1d(v)]


def predictor(method: Algorithm, config) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """(t days, y, targets days) to (targets, bands). HANTS and LASSO take each band by itself."""
    if method is Algorithm.HARMONIC:
        c = config or HarmonicConfig()
        return lambda t, y, at: harmonic.predict_vector(harmonic.fit_vector(t * DAY, y, c), at * DAY)
    if method is Algorithm.HANTS:
        c = config or HantsConfig()
        return lambda t, y, at: np.column_stack([hants.predict(hants.fit(t, v, c), at) for v in y.T])
    c = config or LassoConfig()

    def by_lasso(t, y, at):
        out = []
        for v in y.T:
            segment = lasso.fit_segment(t, v, c.lasso_alpha)
            out.append(segment.predict(at) if segment else np.full(len(at), lasso.fit_predict(t, v, 0.0, c.lasso_alpha)[0]))
        return np.column_stack(out)

    return by_lasso


def _vectors(column) -> list:
    """A list column of an Arrow batch as arrays: numbers as vectors, lists of as many numbers each as matrices; nulls are NaN. Others as
    Python values."""
    import pyarrow as pa

    kind = column.type
    if not pa.types.is_list(kind):
        return column.to_pylist()
    at = column.offsets.to_numpy().tolist()
    numbers = lambda a: a.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if pa.types.is_floating(kind.value_type):
        flat = numbers(column.values)
        rows = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    elif pa.types.is_list(kind.value_type) and pa.types.is_floating(kind.value_type.value_type):
        inner = column.values
        if inner.null_count:
            return column.to_pylist()
        flat, inside = numbers(inner.values), inner.offsets.to_numpy()
        rows = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            first, last = int(inside[a]), int(inside[b])
            wide = (last - first) // max(b - a, 1)
            if (np.diff(inside[a : b + 1]) != wide).any():
                return column.to_pylist()
            rows.append(flat[first:last].reshape(b - a, wide) if b > a else np.empty((0, 0)))
    else:
        return column.to_pylist()
    return [None if null else r for r, null in zip(rows, column.is_null().to_pylist(), strict=True)] if column.null_count else rows


def map_series(series: DataFrame, make: Callable, schema: str, keep: list[str]) -> DataFrame:
    """Rows of make(row as dict) for each pixel, with the kept columns in front. Arrays of numbers come as numpy arrays, cut out of the
    batch's buffers."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kept = [f for f in series.schema if f.name in keep]
    kept.sort(key=lambda f: keep.index(f.name))
    out = StructType([*kept, *StructType.fromDDL(schema)])
    types = to_arrow_schema(out)

    def run(batches) -> Iterator:
        for b in batches:
            columns = {name: _vectors(b.column(i)) for i, name in enumerate(b.schema.names)}
            held = {name: b.column(i).to_pylist() for i, name in enumerate(b.schema.names) if name in keep}
            rows = []
            for i in range(b.num_rows):
                first = tuple(held[c][i] for c in keep)
                rows += [(*first, *x) for x in make({name: v[i] for name, v in columns.items()})]
            made = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(made, types, strict=True)], schema=types)

    return series.mapInArrow(run, out)


def predict(series: DataFrame, keys: list[str], method: str | Algorithm, config=None, target: str = "target") -> DataFrame:
    """Keys, target and pred (an array of bands) for each pixel."""
    run = predictor(Algorithm.parse(method) if isinstance(method, str) else method, config)

    def make(r):
        t, y = arrays(r["t"], r["y"])
        yield (_nullable(run(t, y, np.array([r[target]]))[0]),)

    return map_series(series, make, "pred array<double>", [*keys, target])


def predict_curve(series: DataFrame, keys: list[str], method: str | Algorithm, config=None, n: int = 240) -> DataFrame:
    """Dense curves: keys, i, t, pred over n points between the first and the last date."""
    run = predictor(Algorithm.parse(method) if isinstance(method, str) else method, config)

    def make(r):
        t, y = arrays(r["t"], r["y"])
        if not len(t):
            return
        at = np.linspace(t.min(), t.max(), n)
        for i, (a, p) in enumerate(zip(at, run(t, y, at), strict=True)):
            yield i, float(a), _nullable(p)

    return map_series(series, make, "i int, t double, pred array<double>", keys)


def reconstruct(series: DataFrame, keys: list[str], fn: Callable[[np.ndarray, np.ndarray, float], float], target: str = "target") -> DataFrame:
    """Any function of (t, values that are there, target), for each band: keys, band (from 0), pred."""

    def make(r):
        t, y = arrays(r["t"], r["y"])
        for b, v in enumerate(y.T):
            ok = np.isfinite(v)
            yield b, *_nullable(fn(t[ok], v[ok], r[target]))

    return map_series(series, make, "band int, pred double", keys)


FIT_SCHEMA = "valid boolean, freqs array<double>, t_min double, t_rel_mean double, centers array<double>, scales array<double>, theta array<array<double>>, n_used int"


def fit_vector(series: DataFrame, keys: list[str], config: HarmonicConfig | None = None) -> DataFrame:
    """The vector model of each pixel as columns; t_min and t_rel_mean in seconds, frequencies in Hz."""
    c = config or HarmonicConfig()

    def make(r):
        t, y = arrays(r["t"], r["y"])
        m = harmonic.fit_vector(t * DAY, y, c)
        yield m.valid, m.freqs.tolist(), m.t_min, m.t_rel_mean, np.asarray(m.centers).tolist(), np.asarray(m.scales).tolist(), m.theta.tolist(), len(m.rows)

    return map_series(series, make, FIT_SCHEMA, keys)


def evaluate_vector(models: DataFrame, keys: list[str], target: str, trend: bool = True) -> DataFrame:
    """E2 as an expression over stored models: keys, target, pred. target in days; no Python runs."""
    rel = F.col(target) * DAY - F.col("t_min")
    waves = F.flatten(F.transform("freqs", lambda f: F.array(F.cos(2 * F.pi() * f * rel), F.sin(2 * F.pi() * f * rel))))
    head = [F.lit(1.0), rel - F.col("t_rel_mean")] if trend else [F.lit(1.0)]
    basis = F.concat(F.array(*head), waves)
    start = F.transform("centers", lambda _: F.lit(0.0))
    z = F.aggregate(F.zip_with(basis, "theta", lambda b, row: F.transform(row, lambda v: b * v)), start, lambda s, row: F.zip_with(s, row, lambda a, b: a + b))
    pred = F.zip_with(F.zip_with(z, "scales", lambda a, b: a * b), "centers", lambda a, b: a + b)
    return models.select(*keys, target, F.when(F.col("valid"), pred).alias("pred"))


def predict_scalar(series: DataFrame, keys: list[str], config: HarmonicConfig | None = None, target: str = "target") -> DataFrame:
    """Waves and steps for each band by itself: keys, band, pred, n_freqs."""
    c = config or HarmonicConfig()

    def make(r):
        t, y = arrays(r["t"], r["y"])
        for b, v in enumerate(y.T):
            p, n = harmonic.predict_pixel(t * DAY, v, r[target] * DAY, c)
            yield b, *_nullable(p), n

    return map_series(series, make, "band int, pred double, n_freqs int", keys)


def predict_joint(series: DataFrame, keys: list[str], config: HarmonicConfig | None = None, target: str = "target") -> DataFrame:
    """Waves of each band and steps that all bands share: keys, target, pred (an array of bands)."""
    c = config or HarmonicConfig()

    def make(r):
        t, y = arrays(r["t"], r["y"])
        yield (_nullable(joint.predict_joint(t * DAY, y, r[target] * DAY, c)),)

    return map_series(series, make, "pred array<double>", [*keys, target])


def fit_scalar(series: DataFrame, keys: list[str], config: HarmonicConfig | None = None, target: str = "target") -> DataFrame:
    """Huber ridge with outlier removal for each band: keys, band, valid, n_freqs, pred."""
    c = config or HarmonicConfig()

    def make(r):
        t, y = arrays(r["t"], r["y"])
        for b, v in enumerate(y.T):
            m = harmonic.fit_scalar(t * DAY, v, c)
            yield b, m.valid, len(m.freqs), *_nullable(harmonic.predict_scalar(m, r[target] * DAY))

    return map_series(series, make, "band int, valid boolean, n_freqs int, pred double", keys)


def fit_steps(series: DataFrame, keys: list[str], periods: list[float], config: HarmonicConfig | None = None, target: str = "target") -> DataFrame:
    """E5: waves at given periods (days) with steps: keys, band, valid, pred."""
    c = config or HarmonicConfig()
    freqs = [1 / (p * DAY) for p in periods]

    def make(r):
        t, y = arrays(r["t"], r["y"])
        for b, v in enumerate(y.T):
            m = harmonic.fit_steps(t * DAY, v, freqs, c)
            yield b, m is not None, *(_nullable(harmonic.predict_scalar(m, r[target] * DAY)) if m else [None])

    return map_series(series, make, "band int, valid boolean, pred double", keys)


def fit_hants(series: DataFrame, keys: list[str], config: HantsConfig | None = None, target: str = "target") -> DataFrame:
    """Keys, band, valid, coeffs, n_iterations, pred."""
    c = config or HantsConfig()

    def make(r):
        t, y = arrays(r["t"], r["y"])
        for b, v in enumerate(y.T):
            m = hants.fit(t, v, c)
            yield b, m.valid, _nullable(m.coeffs), m.n_iterations, *_nullable(hants.predict(m, r[target]))

    return map_series(series, make, "band int, valid boolean, coeffs array<double>, n_iterations int, pred double", keys)


def fit_lasso(series: DataFrame, keys: list[str], config: LassoConfig | None = None, target: str = "target") -> DataFrame:
    """Keys, band, pred, qa, rmse, break_positions."""
    c = config or LassoConfig()

    def make(r):
        t, y = arrays(r["t"], r["y"])
        for b, v in enumerate(y.T):
            s = lasso.fit_segment(t, v, c.lasso_alpha)
            if s:
                yield b, *_nullable(s.predict(r[target])), s.order, s.rmse, lasso.breaks(s, t, v)
            else:
                yield b, *_nullable(lasso.fit_predict(t, v, r[target], c.lasso_alpha)[0]), 0, None, []

    return map_series(series, make, "band int, pred double, qa int, rmse double, break_positions array<int>", keys)


def joint_spectra(series: DataFrame, keys: list[str], n: int = 480, low: float = 0.05, high: float = 6.0) -> DataFrame:
    """V8: keys, i, cycles (a year), joint (power of all bands, relative to its largest) and bands (each band's share of that scale), on
    the dates where every band is there."""
    from ..kernels import spectrum

    def make(r):
        t, y = arrays(r["t"], r["y"])
        ok = np.isfinite(y).all(1)
        if not ok.any():
            return
        cycles, p = spectrum.joint_spectrum(t[ok] / 365.25, y[ok], n, low, high)
        joint = p.sum(1)
        top = joint.max()
        for i in range(n):
            yield i, float(cycles[i]), float(joint[i] / top) if top > 0 else None, _nullable(p[i] / top) if top > 0 else None

    return map_series(series, make, "i int, cycles double, joint double, bands array<double>", keys)


def spectra(series: DataFrame, keys: list[str], modes: int, method: str = "direct", scale: float = 1.0) -> DataFrame:
    """K1-K3: keys, k, freq (1/day), power summed over bands, on the dates where every band is there."""
    from ..kernels import spectrum

    def make(r):
        t, y = arrays(r["t"], r["y"])
        ok = np.isfinite(y).all(1)
        if ok.any():
            f, p = spectrum.power(t[ok] - t[ok].min(), y[ok], modes, scale, method)
            for k in range(len(f)):
                yield k, float(f[k]), float(p[k])

    return map_series(series, make, "k int, freq double, power double", keys)
