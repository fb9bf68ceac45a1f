import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronopix.config import Algorithm, ConfigError, HantsConfig, HarmonicConfig, LassoConfig
from chronopix.kernels import basics, hants, harmonic, joint, lasso, ridge, spectrum, steps

DAY = 86400.0


def test_solve_known_system():
    assert np.allclose(ridge.solve([[2, 1], [1, 3]], [5, 5]), [2, 1])
    assert ridge.solve([[1, 1], [1, 1]], [1, 2]) is None


def test_least_squares_line():
    x = ridge.design([0.0, 1.0, 2.0], [], trend=True)
    assert np.allclose(ridge.normal_solution(x, np.array([2.0, 5.0, 8.0])), [5, 3])


def test_tridiagonal():
    assert np.allclose(steps.tridiagonal([2, 2, 2], [-1, -1], [[1.0], [0], [0]])[:, 0], [0.75, 0.5, 0.25])


def test_huber():
    assert np.allclose(ridge.huber_weights([0.1, -0.2, 0.01], 0.05), [0.5, 0.25, 1])


def test_parabola_peak():
    assert spectrum.parabola(np.array([1.0, 2, 3]), np.array([3.0, 4, 3]), 1) == 2.0


def test_even_and_powers():
    assert [spectrum.next_even(n) for n in (1, 2, 3, 4095, 4096)] == [2, 2, 4, 4096, 4096]
    assert [spectrum.next_power_of_two(n) for n in (1, 2, 3, 128, 129)] == [2, 2, 4, 128, 256]


def test_outlier_rules():
    r = [-0.5, -0.01, 0, 0.01, 0.5]
    assert hants.outliers(r, 0.1, "low").tolist() == [True, False, False, False, False]
    assert hants.outliers(r, 0.1, "high").tolist() == [False, False, False, False, True]
    assert hants.outliers(r, 0.1, "none").tolist() == [True, False, False, False, True]


def test_orders_and_fallback():
    assert [lasso.model_order(n) for n in (0, 5, 6, 17, 18, 23, 24)] == [0, 0, 1, 1, 2, 2, 3]
    assert lasso.fit_predict(np.arange(5.0), [1, 5, 3, 2, np.nan], 9.0, 0.1) == (2.5, 0)
    assert np.isnan(lasso.fit_predict([1.0], [np.nan], 9.0, 0.1)[0])


def test_joint_outliers_reject_one_row():
    r = np.array([[0.1, 0.1], [0.0, 0.1], [9.0, 9.0], [0.1, 0.0], [0.05, 0.1]])
    assert steps.joint_outliers(r, np.ones(2), 2.0).tolist() == [True, True, False, True, True]


def test_hants_one_sided():
    t, y = np.arange(4.0), np.array([1.0, 1, 1, 10])
    assert hants.predict(hants.fit(t, y, HantsConfig(nof=1, sf="high", fet=1.0, dod=0)), 0.0)[0] == pytest.approx(1.0)
    assert hants.predict(hants.fit(t, y, HantsConfig(nof=1, sf="low", fet=1.0, dod=0)), 0.0)[0] > 2.0


def test_hants_range_and_too_few():
    y = np.array([0.2, 0.4, 0.8, 0.9])
    fit = hants.fit(np.arange(4.0), y, HantsConfig(nof=1, sf="none", fet=10, dod=0, valid_min=0.7))
    assert hants.predict(fit, 1.0)[0] == pytest.approx(0.85)
    few = hants.fit(np.arange(4.0), np.array([0.0, 0, 10, 10]), HantsConfig(nof=1, sf="none", fet=0.1, dod=3))
    assert not few.valid and hants.predict(few, 0.0)[0] == 5.0


def test_hants_recovers_harmonics():
    t = np.arange(80) * 30.0
    y = 1800 + 400 * np.sin(2 * np.pi * t / 365.25)
    y[::13] -= 1200
    fit = hants.fit(t, y, HantsConfig(sf="low", fet=200))
    clean = np.setdiff1d(np.arange(80), np.arange(0, 80, 13))
    assert np.abs(hants.predict(fit, t[clean]) - y[clean]).max() < 100


def slow_lasso(x, y, alpha, rounds=4000):
    n, p = x.shape
    xc, yc, w = x - x.mean(0), y - y.mean(), np.zeros(x.shape[1])
    for _ in range(rounds):
        for j in range(p):
            r = yc - xc @ w + xc[:, j] * w[j]
            z, q = xc[:, j] @ r / n, xc[:, j] @ xc[:, j] / n
            w[j] = 0 if q == 0 else np.sign(z) * max(abs(z) - alpha, 0) / q
    return w, y.mean() - x.mean(0) @ w


def test_lasso_matches_plain_loops():
    rng = np.random.default_rng(3)
    t = np.sort(rng.uniform(0, 730, 50))
    x = lasso.harmonics(t, 2, t.mean())
    y = 0.5 + 0.3 * x[:, 0] + rng.normal(size=50) * 0.05
    w, b = lasso.coordinate_descent(x, y, 0.01)
    v, c = slow_lasso(x, y, 0.01)
    assert np.allclose(w, v, atol=1e-6) and b == pytest.approx(c, abs=1e-6)


def test_breaks_after_a_step():
    t = np.arange(0, 800, 10.0)
    y = np.where(t < 500, 1.0, 9.0) + 0.01 * np.sin(t)
    s = lasso.fit_segment(t[:50], y[:50], 0.0)
    assert lasso.breaks(s, t, y)[0] == 50


def test_temporal_rmse_of_nearest():
    t, y = np.array([1.0, 2, 100, 366.25, 367.25]), np.array([1.0, 2, 50, 3, np.nan])
    assert lasso.temporal_rmse(t, y, 1.5, 3) == pytest.approx(np.std([1, 2, 3]))
    assert lasso.temporal_rmse(t, y, 1.5, 5) is None


def test_gridded_power_agrees_with_direct():
    rng = np.random.default_rng(5)
    t, y = np.sort(rng.uniform(0, 900, 300)), rng.normal(size=(300, 3))
    f1, p1 = spectrum.power(t, y, 64, method="direct")
    f2, p2 = spectrum.power(t, y, 64, method="gridded")
    assert np.allclose(f1, f2) and np.abs(p1 - p2).max() < 2e-4 * p1.max()
    each = sum(spectrum.power(t, c, 64, method="direct")[1] for c in y.T)
    assert np.allclose(p1, each)


def test_direct_power_by_definition():
    t, y = np.array([0.0, 1.0, 2.5, 4.0]), np.array([1.0, 2.0, -1.0, 0.5])
    _, p = spectrum.power(t, y, 8, method="direct")
    for k in range(4):
        x = 2 * np.pi * t / 4 - np.pi
        assert p[k] == pytest.approx(abs(sum(v * np.exp(-1j * k * a) for v, a in zip(y, x, strict=True))) ** 2)


def slow_fused(r, lam, w, rounds=40000):
    limit, z = lam * w, np.zeros(len(r) - 1)
    for _ in range(rounds):
        z = np.clip(z + 0.25 * np.diff(r - steps.transposed_difference(z)), -limit, limit)
    return r - steps.transposed_difference(z)


@settings(max_examples=15, deadline=None)
@given(st.integers(2, 24), st.floats(0.01, 3), st.integers(0, 10**6))
def test_fused_lasso_matches_projected_gradients(n, lam, seed):
    rng = np.random.default_rng(seed)
    r, w = rng.normal(size=n), rng.uniform(0.2, 1, n - 1)
    u, v = steps.fused_lasso(r, lam, w), slow_fused(r, lam, w)
    cost = lambda x: 0.5 * ((r - x) ** 2).sum() + lam * (w * np.abs(np.diff(x))).sum()
    assert cost(u) <= cost(v) + 1e-9 and np.abs(u - v).max() < 1e-3


def test_fused_lasso_edges():
    r = np.array([1.0, 2, 3])
    assert steps.fused_lasso(r, 0, np.ones(2)).tolist() == r.tolist()
    assert steps.fused_lasso(r, 1e7, np.ones(2)).tolist() == [0, 0, 0]


def test_group_fused_lasso_finds_shared_break():
    r = np.zeros((10, 2))
    r[5:] = (1.0, -0.5)
    u = steps.group_fused_lasso(r, 0.3, np.ones(9), rounds=500, tol=1e-8)
    jump = np.linalg.norm(np.diff(u, axis=0), axis=1)
    assert jump.argmax() == 4 and np.delete(jump, 4).max() < 1e-3
    assert steps.group_fused_lasso(r, 1e5, np.ones(9))[0].tolist() == pytest.approx(r.mean(0).tolist())


def test_penalties():
    f = np.array([1.0, 2.0, 4.0]) / (365.25 * DAY)
    assert np.allclose(ridge.frequency_penalty(f, 3.0) ** 2, [1, 4, 7])
    d = ridge.tiered_penalty(f, 0.5, 2.0, 100.0, 0.0, free=[f[0]])
    assert d.tolist() == [0.5, 0.5, 0, 0, 0.5, 0.5, 2.0, 2.0]


def test_multi_output_ridge_by_normal_equations():
    rng = np.random.default_rng(2)
    x, z, w, pen = rng.normal(size=(30, 4)), rng.normal(size=(30, 3)), rng.uniform(0.1, 1, 30), np.array([0.1, 0.2, 0.3, 0.4])
    a = x.T @ (w[:, None] * x) + np.diag(pen)
    assert np.allclose(ridge.MultiRidge(x, z, pen, 0.0).solve(w), np.linalg.solve(a, x.T @ (w[:, None] * z)))
    theta = ridge.MultiRidge(x, z, pen, 0.7).solve(w)
    rhs = x.T @ (w[:, None] * z)
    mean = rhs.mean(1, keepdims=True)
    s = np.diag([0, 0.7, 0.7, 0.7])
    assert np.allclose(theta, np.linalg.solve(a, mean) + np.linalg.solve(a + s, rhs - mean))


def test_vector_fit_keeps_band_order_and_recovers():
    t = np.arange(36) * 10.0
    y = np.column_stack([m + a * np.sin(2 * np.pi * t / 120) for m, a in ((1000, 100), (1500, 150), (2200, 220))])
    c = HarmonicConfig(ridge_lam=1e-6, lambda_high=1e-6, multiband_shrinkage=0.0, modes=16, freq_weight=0.0)
    fit = harmonic.fit_vector(t * DAY, y, c)
    p = harmonic.predict_vector(fit, 180 * DAY)[0]
    assert fit.valid and p[0] < p[1] < p[2]
    assert np.abs(harmonic.predict_vector(fit, t * DAY) - y).max() < 20


def test_vector_fit_rejects_an_outlier():
    t = np.arange(60) * 10.0
    y = np.column_stack([0.3 * np.sin(2 * np.pi * t / 365.25) + 0.5, 0.2 * np.cos(2 * np.pi * t / 365.25) + 0.6]) * 10_000
    y[30] += 8000
    c = HarmonicConfig(outlier_reject_iters=2, modes=8)
    assert 30 not in harmonic.fit_vector(t * DAY, y, c).rows


def test_vector_fit_without_enough_dates():
    fit = harmonic.fit_vector(np.arange(5) * DAY, np.ones((5, 2)), HarmonicConfig())
    assert not fit.valid and np.isnan(harmonic.predict_vector(fit, 0.0)).all()


def test_normalisation_modes():
    y = np.array([[1.0], [2], [3], [10]])
    assert harmonic.normalise(y, "reflectance") == (pytest.approx([0.0]), pytest.approx([10_000.0]))
    assert harmonic.normalise(y, "centered_reflectance")[0] == pytest.approx([2.5])
    assert harmonic.normalise(y, "robust")[1] == pytest.approx([1.4826])
    assert harmonic.normalise(np.array([[4.0], [4], [4], [8]]), "robust")[1] == pytest.approx([np.std([4, 4, 4, 8])])


def test_scalar_models_track_a_clean_signal():
    t = np.arange(50) * 15.0
    y = (0.5 + 0.2 * np.sin(2 * np.pi * t / 365.25) + 0.1 * np.cos(4 * np.pi * t / 365.25)) * 10_000
    c = HarmonicConfig(modes=64, frequency_selection="hybrid", ridge_lam=1e-4, lambda_high=1e-4, freq_weight=0.0)
    p, n = harmonic.predict_pixel(t * DAY, y, 300 * DAY, c)
    want = (0.5 + 0.2 * np.sin(2 * np.pi * 300 / 365.25) + 0.1 * np.cos(4 * np.pi * 300 / 365.25)) * 10_000
    assert n > 0 and abs(p - want) < 300
    m = harmonic.fit_scalar(t * DAY, y, c)
    assert m.valid and abs(harmonic.predict_scalar(m, 300 * DAY)[0] - want) < 500
    assert harmonic.predict_pixel(t[:3] * DAY, y[:3], 0.0, c) == (pytest.approx(y[:3].mean()), 0)


def test_selection_modes():
    f, p = np.arange(10) / 1000.0, np.array([9.0, 1, 8, 1, 1, 7, 1, 1, 1, 1])
    c = HarmonicConfig(spectral_top_k=2, refine_peaks=False, power_cum=1.0, spectral_merge_tol=0.0)
    assert spectrum.select_frequencies(f, p, 1.0, "spectral", [], c).tolist() == [0.002, 0.005]
    assert len(spectrum.select_frequencies(f, p, 1.0, "all", [0.0021], c)) == 9
    assert spectrum.select_frequencies(f, p, 1.0, "preferred", [0.0021], c).tolist() == [0.002]
    assert spectrum.merge_near([1.0, 1.1, 5.0], 0.15) == [1.05, 5.0]


def test_frequencies_of_periods():
    assert spectrum.preferred_frequencies("365.25, x, -3,") == [pytest.approx(1 / (365.25 * DAY))]


def test_configs_are_strict():
    assert HarmonicConfig.load('{"harmonic": {"ridge": 0.3}}').ridge_lam == 0.3
    assert LassoConfig.load('{"lasso_alpha": 0.2}').lasso_alpha == 0.2
    with pytest.raises(ConfigError):
        HantsConfig.load('{"nope": 1}')
    with pytest.raises(ConfigError):
        HantsConfig(nof=0).validate()
    HarmonicConfig().validate()
    assert Algorithm.parse(" HANTS ") is Algorithm.HANTS


def test_basics():
    assert basics.nanmedian([1, np.nan, 4]) == 2.5 and basics.mad_std([]) == 0
    t, target = basics.days_to_seconds([0, 10.0], 5)
    assert t[1] == 864000 and target == 432000
    assert basics.days_to_seconds([0, 1e6], 5)[1] == 5


def stepped(n=160, seed=1):
    """Three bands with a season, a small wave of one band's own, and steps at the same date."""
    rng = np.random.default_rng(seed)
    t = np.sort(rng.choice(np.arange(0, 1800, 5), n, replace=False)).astype(float)
    season = np.sin(2 * np.pi * t / 365.25)
    y = np.column_stack([2000 + 400 * season, 3000 + 600 * season + 60 * np.cos(2 * np.pi * t / 91.3), 1500 - 300 * season])
    y += np.where(t[:, None] > 900, [800.0, -600.0, 400.0], 0.0) + rng.normal(0, 20, y.shape)
    return t, y


def test_joint_steps():
    t, y = stepped()
    c = HarmonicConfig(modes=128, ridge_lam=0.01, freq_weight=1.0, lambda_step=0.2, lambda_high=0.02, frequency_selection="spectral", include_trend=False, power_cum=0.98)
    hole = (t > 1200) & (t < 1260)
    truth = y[hole].mean(0)
    got = np.mean([joint.predict_joint(t[~hole] * 86400, y[~hole], x * 86400, c) for x in t[hole]], axis=0)
    assert np.abs(got - truth).max() < 250
    without = np.mean([joint.predict_joint(t[~hole] * 86400, y[~hole], x * 86400, HarmonicConfig(**{**c.__dict__, "lambda_step": 1e7})) for x in t[hole]], axis=0)
    assert np.abs(got - truth).max() < 0.7 * np.abs(without - truth).max()


def test_joint_model_of_too_little():
    t, y = stepped(40)
    c = HarmonicConfig(modes=64)
    y[5:, 1] = np.nan
    assert np.isnan(joint.predict_joint(t * 86400, y, 86400.0, c)).all()
    assert np.isnan(joint.predict_joint(t[:5], y[:5], 1.0, c)).all()


def test_private_frequencies_keep_apart():
    f = np.arange(1, 21) * 0.05
    p = np.ones(20)
    p[[3, 4, 9, 15]] = [50, 40, 30, 20]
    c = HarmonicConfig(refine_peaks=False, num_peaks=6, power_cum=0.95, ignore_dc_hz=0.0, spectral_merge_tol=0.05, private_top_k_per_band=2)
    assert joint.private_frequencies(f, p, [0.2], 1.0, c) == pytest.approx([0.25, 0.5])
    assert joint.private_frequencies(f, p, [0.2, 0.5], 1.0, c) == pytest.approx([0.25, 0.8])
    both = joint.mixed_penalty([0.2, 0.25, 0.5], [0.2], [0.25, 0.5], HarmonicConfig(ridge_lam=1.0, freq_weight=0.0, lambda_high=0.0, private_freq_penalty_mult=2.0))
    assert both.tolist() == [1, 1, 1, 1, 4, 4, 4, 4]


def test_gridded_power_of_coherent_times():
    """Samples that all lie between two nodes of the grid: there a kernel with a fixed parameter of 10 is off by over a ten-thousandth."""
    t = (np.arange(128) + 0.5) * 1.0
    t, y = np.concatenate(([0.0], t, [128.0])), np.ones((130, 1))
    _, p1 = spectrum.power(t, y, 64, method="direct")
    _, p2 = spectrum.power(t, y, 64, method="gridded")
    assert np.abs(p1 - p2).max() < 1e-6 * p1.max()


def test_hants_ends_with_the_fit_of_the_last_pass():
    t, y = np.arange(12.0), np.array([0.0] * 8 + [10, 30, 90, 300])
    passes = [hants.fit(t, y, HantsConfig(nof=1, sf="high", fet=1.0, dod=0, passes=k)) for k in (1, 2, None)]
    assert [f.n_iterations for f in passes] == [1, 2, 3]
    assert [f.coeffs[0] for f in passes] == pytest.approx([y.mean(), y[:10].mean(), 0.0])
