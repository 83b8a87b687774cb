"""Residual diagnostics of one series on arrays; fjordline.operators.diagnose has them over DataFrames."""

from __future__ import annotations

import math

import numpy as np

from fjordline.plans.model import FilterResult, StateSpaceModel


def standardized_residuals(r: FilterResult, model: StateSpaceModel) -> np.ndarray:
    """Prediction errors over their standard deviations: (T,) of one observed value, else (T, m).  NaN where y is."""
    error = r.observations - r.predicted_states @ model.F.T
    spread = np.diagonal(model.F @ r.predicted_covariances @ model.F.T + model.V, axis1=-2, axis2=-1)
    out = error / np.sqrt(spread)
    return out[:, 0] if model.obs_dim == 1 else out


def acf(x: object, n_lags: int = 20) -> np.ndarray:
    """Biased autocorrelations of lags 0 .. n_lags; 0 beyond the series."""
    x = np.ravel(np.asarray(x, float))
    x = x - x.mean()
    out = np.zeros(n_lags + 1)
    out[0] = 1.0
    total = x @ x
    for k in range(1, min(n_lags, len(x) - 1) + 1):
        out[k] = x[k:] @ x[:-k] / total
    return out


def pacf_from_acf(r: np.ndarray) -> np.ndarray:
    """Durbin-Levinson.  Where the recursion breaks down (|denominator| < 1e-12) it gives 0 and starts over."""
    out = np.zeros(len(r))
    out[0] = 1.0
    phi = np.zeros(0)
    for k in range(1, len(r)):
        below = 1 - phi @ r[1:k]
        if abs(below) < 1e-12:
            phi = np.zeros(k)
            continue
        out[k] = (r[k] - phi @ r[k - 1 : 0 : -1]) / below
        phi = np.append(phi - out[k] * phi[::-1], out[k])
    return out


def pacf(x: object, n_lags: int = 20) -> np.ndarray:
    return pacf_from_acf(acf(x, n_lags))


def chi2_sf(q: float, df: int) -> float:
    """Upper tail of the chi-square distribution: finite sums for whole degrees of freedom."""
    if not q > 0:
        return 1.0 if q == q else math.nan
    half = q / 2
    if df % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, df // 2):
            term *= half / i
            total += term
        return math.exp(-half) * total
    total, term = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for i in range(1, (df + 1) // 2):
        total += term
        term *= half / (i + 0.5)
    return total


def ljung_box(residuals: object, n_lags: int = 10) -> tuple[float, float]:
    """(statistic, p-value) with n_lags degrees of freedom.  Missing residuals are left out first."""
    x = np.ravel(np.asarray(residuals, float))
    x = x[~np.isnan(x)]
    n = len(x)
    if n_lags >= n:
        raise ValueError(f"{n_lags} lags need more than {n} residuals")
    r = acf(x, n_lags)[1:]
    q = n * (n + 2) * float((r * r / (n - np.arange(1, n_lags + 1))).sum())
    return q, chi2_sf(q, n_lags)


def aic(log_likelihood: float, state_dim: int) -> float:
    return -2 * log_likelihood + 2 * state_dim
