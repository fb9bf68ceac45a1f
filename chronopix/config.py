"""Model settings: strict dataclasses read from JSON, grouped section first, then flat."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from enum import Enum


class Algorithm(str, Enum):
    """Reconstruction methods; the first one's name in files and options is `harmonic`."""

    HARMONIC = "harmonic"
    HANTS = "hants"
    LASSO = "zhu2015"

    @classmethod
    def parse(cls, text: str) -> Algorithm:
        return cls(text.strip().lower())


class ConfigError(ValueError):
    pass


class _Strict:
    section = ""
    aliases: dict[str, str] = {}

    @classmethod
    def from_dict(cls, values: dict):
        known = {f.name for f in fields(cls)}
        named = {cls.aliases.get(k, k): v for k, v in values.items()}
        if unknown := sorted(set(named) - known):
            raise ConfigError(f"unknown settings: {', '.join(unknown)}")
        return cls(**named)

    @classmethod
    def load(cls, text: str):
        """From JSON that holds either a section of this model's name or its settings themselves."""
        values = json.loads(text)
        return cls.from_dict(values.get(cls.section, values))


@dataclass(frozen=True)
class HarmonicConfig(_Strict):
    """The vector and scalar harmonic models. Defaults are those of the active configuration for reflectance series."""

    modes: int = 200
    eps: float = 1e-12
    num_peaks: int = 10
    power_cum: float = 0.7
    ignore_dc_hz: float = 1e-10
    frequency_selection: str = "all"
    preferred_periods_days: str = "365.25,182.625,91.3125,30.4375"
    preferred_top_k: int = 4
    spectral_top_k: int = 8
    spectral_merge_tol: float = 0.15
    private_top_k_per_band: int = 2
    private_freq_penalty_mult: float = 1.5
    refine_peaks: bool = True
    include_trend: bool = True
    ridge_lam: float = 0.05
    freq_weight: float = 84.0
    multiband_shrinkage: float = 0.625
    normalization_mode: str = "reflectance"
    huber_iters: int = 5
    huber_delta: float = 0.12
    min_obs: int = 12
    outlier_sigma: float = 2.5
    outlier_reject_iters: int = 0
    outlier_reject_sigma: float = 2.5
    outlier_reject_max_fraction: float = 0.35
    lambda_step: float = 0.05
    lambda_high: float = 0.2
    low_freq_period_days: float = 60.0
    step_dt_weighting: bool = True
    max_outer_iter: int = 5
    outer_tol: float = 1e-3
    joint_outlier: bool = True
    joint_outlier_sigma: float = 2.5
    admm_rho: float = 1.0
    admm_max_iter: int = 80
    admm_tol: float = 1e-4
    spectrum: str = "gridded"

    section = "harmonic"
    aliases = {"ridge": "ridge_lam"}

    @property
    def mode(self) -> str:
        known = {"all": "all", "preferred": "preferred", "hybrid": "hybrid", "shared_spectral": "hybrid"}
        return known.get(self.frequency_selection, "spectral")

    def validate(self) -> None:
        positive = ("modes", "eps", "num_peaks", "min_obs", "low_freq_period_days")
        for name in positive:
            if not getattr(self, name) > 0:
                raise ConfigError(f"{name} must be positive")
        if not 0 <= self.power_cum <= 1:
            raise ConfigError("power_cum must lie in [0, 1]")
        for name in ("ridge_lam", "freq_weight", "multiband_shrinkage", "huber_delta", "lambda_step", "lambda_high", "outer_tol"):
            if getattr(self, name) < 0:
                raise ConfigError(f"{name} must not be negative")


@dataclass(frozen=True)
class HantsConfig(_Strict):
    nof: int = 3
    sf: str = "high"
    fet: float = 500.0
    dod: int = 5
    valid_min: float | None = None
    valid_max: float | None = None
    period: float = 365.25
    passes: int | None = None

    section = "hants"

    def validate(self) -> None:
        if self.nof < 1 or self.period <= 0 or self.fet < 0:
            raise ConfigError("nof and period must be positive, fet not negative")
        if self.passes is not None and self.passes < 1:
            raise ConfigError("passes must be positive")
        if self.sf not in ("low", "high", "none"):
            raise ConfigError("sf must be low, high or none")


@dataclass(frozen=True)
class LassoConfig(_Strict):
    lasso_alpha: float = 0.1

    section = "zhu2015"

    def validate(self) -> None:
        if not self.lasso_alpha >= 0:
            raise ConfigError("lasso_alpha must not be negative")
