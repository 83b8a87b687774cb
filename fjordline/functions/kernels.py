"""Numerical kernels over stacks of series: arrays have a leading axis of series, then time.

A value is missing if it is NaN; a row with any missing value is skipped: the belief stays the prediction and
the row adds nothing to the likelihood.  A singular innovation covariance gives NaN for that series from there on, never an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist
from typing import NamedTuple

import numpy as np

from fjordline.plans.model import FilterResult, ForecastResult, GaussianState, NonlinearSSM, SmootherResult, StateSpaceModel

LN_2PI = math.log(2 * math.pi)


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a^-1 b for stacks; NaN where a is singular."""
    if a.shape[-1] == 1:
        with np.errstate(divide="ignore", invalid="ignore"):
            return b / a
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        a, b = np.broadcast_arrays(a, a)[0], np.broadcast_to(b, a.shape[:-2] + b.shape[-2:])
        out = np.full(b.shape, np.nan)
        for k in np.ndindex(a.shape[:-2]):
            try:
                out[k] = np.linalg.solve(a[k], b[k])
            except np.linalg.LinAlgError:
                pass
        return out


def _t(x: np.ndarray) -> np.ndarray:
    return np.swapaxes(x, -1, -2)


def log_density(error: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """ln N(error; 0, cov) for stacks."""
    with np.errstate(divide="ignore", invalid="ignore"):
        _, logdet = np.linalg.slogdet(cov)
        quad = (error * solve(cov, error[..., None])[..., 0]).sum(-1)
    return -0.5 * (error.shape[-1] * LN_2PI + logdet + quad)


class Moments(NamedTuple):
    """By series and time."""

    pred_mean: np.ndarray
    pred_cov: np.ndarray
    filt_mean: np.ndarray
    filt_cov: np.ndarray
    innov: np.ndarray
    innov_cov: np.ndarray
    ll: np.ndarray


def kalman_predict(mean: np.ndarray, cov: np.ndarray, model: StateSpaceModel, u: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    ahead = mean @ model.G.T
    if model.B is not None and u is not None:
        ahead = ahead + u @ model.B.T
    return ahead, model.G @ cov @ model.G.T + model.W


def kalman_update(mean: np.ndarray, cov: np.ndarray, y: np.ndarray, model: StateSpaceModel, design: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(mean, cov, error, its covariance, ll) of beliefs (S, n) given y (S, m)."""
    f = model.F if design is None else design
    gone = np.isnan(y).any(-1)
    error = y - (f @ mean[..., None])[..., 0]
    cross = cov @ _t(f)
    spread = f @ cross + model.V
    gain = _t(solve(_t(spread), _t(cross)))
    filled = np.where(gone[:, None], 0.0, error)
    new_mean = mean + (gain @ filled[..., None])[..., 0]
    new_cov = cov - gain @ f @ cov
    ll = np.where(gone, 0.0, log_density(filled, spread))
    return np.where(gone[:, None], mean, new_mean), np.where(gone[:, None, None], cov, new_cov), error, spread, ll


def kalman_scan(model: StateSpaceModel, y: np.ndarray, prior: GaussianState | None = None, u: np.ndarray | None = None, x: np.ndarray | None = None) -> Moments:
    """y (S, T, m); u (S, T, p) control inputs, zeros if None; x (S, T, n) the row's design vector in place of F (m = 1)."""
    prior = prior or model.initial_state()
    count, steps, n, m = y.shape[0], y.shape[1], model.state_dim, model.obs_dim
    out = Moments(*(np.empty((count, steps, *s)) for s in ((n,), (n, n), (n,), (n, n), (m,), (m, m), ())))
    mean, cov = np.broadcast_to(prior.mean, (count, n)), np.broadcast_to(prior.cov, (count, n, n))
    for t in range(steps):
        mean, cov = kalman_predict(mean, cov, model, None if u is None else u[:, t])
        out.pred_mean[:, t], out.pred_cov[:, t] = mean, cov
        mean, cov, error, spread, ll = kalman_update(mean, cov, y[:, t], model, None if x is None else x[:, t, None, :])
        out.filt_mean[:, t], out.filt_cov[:, t] = mean, cov
        out.innov[:, t], out.innov_cov[:, t], out.ll[:, t] = error, spread, ll
    return out


def steady_plan(model: StateSpaceModel, steps: int, prior: GaussianState | None = None) -> Moments:
    """Covariances, innovation covariances and (in pred_mean's place, (1, T, n, m)) gains, which don't depend on data without gaps: computed once for all series."""
    prior = prior or model.initial_state()
    n, m = model.state_dim, model.obs_dim
    cov = prior.cov[None]
    out = Moments(np.empty((1, steps, n, m)), *(np.empty((1, steps, *s)) for s in ((n, n), (0,), (n, n), (0,), (m, m))), np.empty((1, steps)))
    for t in range(steps):
        cov = model.G @ cov @ model.G.T + model.W
        out.pred_cov[:, t] = cov
        cross = cov @ model.F.T
        spread = model.F @ cross + model.V
        gain = _t(solve(_t(spread), _t(cross)))
        cov = cov - gain @ model.F @ cov
        out.pred_mean[:, t], out.filt_cov[:, t], out.innov_cov[:, t] = gain, cov, spread
        out.ll[:, t] = -0.5 * (m * LN_2PI + np.linalg.slogdet(spread)[1])
    return out


def complete_scan(model: StateSpaceModel, y: np.ndarray, plan: Moments, prior: GaussianState | None = None) -> Moments:
    """kalman_scan() of series without gaps or inputs by the gains of steady_plan(): only means are carried."""
    prior = prior or model.initial_state()
    count, steps = y.shape[:2]
    n, m = model.state_dim, model.obs_dim
    a, f, e, ll = np.empty((count, steps, n)), np.empty((count, steps, n)), np.empty((count, steps, m)), np.empty((count, steps))
    mean = np.broadcast_to(prior.mean, (count, n))
    for t in range(steps):
        mean = mean @ model.G.T
        a[:, t] = mean
        error = y[:, t] - mean @ model.F.T
        mean = mean + error @ plan.pred_mean[0, t].T
        f[:, t], e[:, t] = mean, error
        ll[:, t] = plan.ll[0, t] - 0.5 * (error * solve(plan.innov_cov[:, t], error[..., None])[..., 0]).sum(-1)
    wide = lambda v: np.broadcast_to(v, (count, *v.shape[1:]))
    return Moments(a, wide(plan.pred_cov), f, wide(plan.filt_cov), e, wide(plan.innov_cov), ll)


def rts(model: StateSpaceModel, m: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smoothed means and covariances, and the gains."""
    mean, cov = m.filt_mean.copy(), m.filt_cov.copy()
    gains = np.zeros_like(cov)
    for t in range(mean.shape[1] - 2, -1, -1):
        after = m.pred_cov[:, t + 1]
        gain = _t(solve(_t(after), model.G @ _t(m.filt_cov[:, t])))
        gains[:, t] = gain
        mean[:, t] += (gain @ (mean[:, t + 1] - m.pred_mean[:, t + 1])[..., None])[..., 0]
        cov[:, t] += gain @ (cov[:, t + 1] - after) @ _t(gain)
    return mean, cov, gains


def forecast_maps(model: StateSpaceModel, steps: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """G^h and the evolution noise gathered in h steps, h = 1 .. steps."""
    out, power, noise = [], np.eye(model.state_dim), np.zeros_like(model.W)
    for _ in range(steps):
        noise = model.G @ noise @ model.G.T + model.W
        power = model.G @ power
        out.append((power, noise))
    return out


def forecast(model: StateSpaceModel, last: GaussianState, steps: int) -> ForecastResult:
    maps = forecast_maps(model, steps)
    means = np.array([g @ last.mean for g, _ in maps]).reshape(steps, model.state_dim)
    covs = np.array([g @ last.cov @ g.T + s for g, s in maps]).reshape(steps, model.state_dim, model.state_dim)
    return ForecastResult(means @ model.F.T, model.F @ covs @ model.F.T + model.V, means, covs)


def z_score(level: float) -> float:
    return NormalDist().inv_cdf((1 + level) / 2)


def confidence_bands(means: np.ndarray, covariances: np.ndarray, level: float = 0.95, kind: str = "auto") -> tuple[np.ndarray, np.ndarray]:
    """kind: 'cov' (last two axes a matrix), 'var' (variances beside means), or 'auto': a matrix if there is one axis more than in means."""
    means, covariances = np.asarray(means, float), np.asarray(covariances, float)
    matrix = kind == "cov" or (kind == "auto" and covariances.ndim == means.ndim + 1)
    half = z_score(level) * np.sqrt(np.diagonal(covariances, axis1=-2, axis2=-1) if matrix else covariances)
    return means - half, means + half


# Nonlinear filters: one series at a time, as the functions are the user's.


def jacobian(fn: Callable[[np.ndarray], np.ndarray], at: np.ndarray) -> np.ndarray:
    """By complex steps (exact to rounding), unless fn refuses complex numbers or loses their imaginary part, as central differences show."""
    n, unit = len(at), np.eye(len(at))
    step = 1e-6 * np.maximum(1.0, np.abs(at))
    central = np.stack([(np.atleast_1d(fn(at + step[k] * unit[k])) - np.atleast_1d(fn(at - step[k] * unit[k]))) / (2 * step[k]) for k in range(n)], -1)
    try:
        exact = np.stack([np.atleast_1d(np.imag(np.asarray(fn(at + 1e-30j * unit[k]), complex)) / 1e-30) for k in range(n)], -1)
    except (TypeError, ValueError):
        return central
    return exact if np.allclose(exact, central, rtol=1e-4, atol=1e-6) else central


def ekf_predict(state: GaussianState, model: NonlinearSSM) -> GaussianState:
    j = model.transition_jacobian(state.mean) if model.transition_jacobian else jacobian(model.f, state.mean)
    return GaussianState(model.f(state.mean), j @ state.cov @ j.T + model.Q)


def _correct(pred: GaussianState, y: np.ndarray, expected: np.ndarray, spread: np.ndarray, cross: np.ndarray, shrink: Callable[[np.ndarray], np.ndarray]) -> tuple[GaussianState, float, np.ndarray]:
    error = y - expected
    if np.isnan(y).any():
        return pred, 0.0, error
    gain = solve(spread.T, cross.T).T
    return GaussianState(pred.mean + gain @ error, shrink(gain)), float(log_density(error, spread)), error


def ekf_update(pred: GaussianState, y: np.ndarray, model: NonlinearSSM) -> tuple[GaussianState, float, np.ndarray, np.ndarray]:
    j = model.observation_jacobian(pred.mean) if model.observation_jacobian else jacobian(model.h, pred.mean)
    spread, cross = j @ pred.cov @ j.T + model.R, pred.cov @ j.T
    state, ll, error = _correct(pred, np.atleast_1d(y), np.atleast_1d(model.h(pred.mean)), spread, cross, lambda k: pred.cov - k @ j @ pred.cov)
    return state, ll, error, spread


class SigmaWeights(NamedTuple):
    wm: np.ndarray
    wc: np.ndarray
    lam: float


def sigma_weights(n: int, alpha: float = 1e-3, beta: float = 2.0, kappa: float = 0.0) -> SigmaWeights:
    lam = alpha**2 * (n + kappa) - n
    wm = np.full(2 * n + 1, 0.5 / (n + lam))
    wm[0] = lam / (n + lam)
    wc = wm.copy()
    wc[0] += 1 - alpha**2 + beta
    return SigmaWeights(wm, wc, lam)


def sigma_points(state: GaussianState, lam: float, sigma: str = "rows") -> np.ndarray:
    """2 n + 1 points.  'rows' offsets by the rows of the Cholesky factor, as parity asks; 'columns' is the transform
    that recovers the covariance.  They agree for one state or a diagonal covariance."""
    try:
        root = np.linalg.cholesky((state.dim + lam) * state.cov)
    except np.linalg.LinAlgError:
        root = np.full((state.dim, state.dim), np.nan)
    root = root if sigma == "rows" else root.T
    return state.mean + np.vstack([np.zeros((1, state.dim)), root, -root])


def ukf_predict(state: GaussianState, model: NonlinearSSM, w: SigmaWeights, sigma: str = "rows") -> GaussianState:
    pushed = np.array([np.atleast_1d(model.f(p)) for p in sigma_points(state, w.lam, sigma)])
    mean = w.wm @ pushed
    off = pushed - mean
    return GaussianState(mean, (off.T * w.wc) @ off + model.Q)


def ukf_update(pred: GaussianState, y: np.ndarray, model: NonlinearSSM, w: SigmaWeights, sigma: str = "rows") -> tuple[GaussianState, float, np.ndarray, np.ndarray]:
    points = sigma_points(pred, w.lam, sigma)
    seen = np.array([np.atleast_1d(model.h(p)) for p in points])
    expected = w.wm @ seen
    off = seen - expected
    spread = (off.T * w.wc) @ off + model.R
    cross = ((points - pred.mean).T * w.wc) @ off
    state, ll, error = _correct(pred, np.atleast_1d(y), expected, spread, cross, lambda k: pred.cov - k @ spread @ k.T)
    return state, ll, error, spread


def nonlinear_scan(model: NonlinearSSM, y: np.ndarray, prior: GaussianState | None, predict: Callable, update: Callable) -> Moments:
    """y (T, m) of one series -> Moments with a series axis of 1."""
    state, n, m = prior or model.initial_state(), model.state_dim, model.obs_dim
    out = Moments(*(np.empty((1, len(y), *s)) for s in ((n,), (n, n), (n,), (n, n), (m,), (m, m), ())))
    for t, row in enumerate(y):
        state = predict(state, model)
        out.pred_mean[0, t], out.pred_cov[0, t] = state.mean, state.cov
        state, out.ll[0, t], out.innov[0, t], out.innov_cov[0, t] = update(state, row, model)
        out.filt_mean[0, t], out.filt_cov[0, t] = state.mean, state.cov
    return out


def ekf_scan(model: NonlinearSSM, y: np.ndarray, prior: GaussianState | None = None) -> Moments:
    return nonlinear_scan(model, y, prior, ekf_predict, ekf_update)


def ukf_scan(model: NonlinearSSM, y: np.ndarray, prior: GaussianState | None = None, *, alpha: float = 1e-3, beta: float = 2.0, kappa: float = 0.0, sigma: str = "rows") -> Moments:
    w = sigma_weights(model.state_dim, alpha, beta, kappa)
    return nonlinear_scan(model, y, prior, lambda s, mod: ukf_predict(s, mod, w, sigma), lambda s, row, mod: ukf_update(s, row, mod, w, sigma))


# Single series, for use on arrays.


def rows_of(y: object) -> np.ndarray:
    y = np.asarray(y, float)
    return y[:, None] if y.ndim == 1 else y


def as_result(m: Moments, y: np.ndarray) -> FilterResult:
    return FilterResult(m.filt_mean[0], m.filt_cov[0], m.pred_mean[0], m.pred_cov[0], float(m.ll[0].sum()), y)


def kalman_filter(model: StateSpaceModel, observations: object, initial_state: GaussianState | None = None, inputs: object = None) -> FilterResult:
    y = rows_of(observations)
    return as_result(kalman_scan(model, y[None], initial_state, None if inputs is None else rows_of(inputs)[None]), y)


def ekf_filter(model: NonlinearSSM, observations: object, initial_state: GaussianState | None = None) -> FilterResult:
    y = rows_of(observations)
    return as_result(ekf_scan(model, y, initial_state), y)


def ukf_filter(model: NonlinearSSM, observations: object, initial_state: GaussianState | None = None, **options) -> FilterResult:
    y = rows_of(observations)
    return as_result(ukf_scan(model, y, initial_state, **options), y)


def _moments(r: FilterResult) -> Moments:
    return Moments(r.predicted_states[None], r.predicted_covariances[None], r.filtered_states[None], r.filtered_covariances[None], None, None, None)


def rts_smooth(model: StateSpaceModel, r: FilterResult) -> SmootherResult:
    mean, cov, _ = rts(model, _moments(r))
    return SmootherResult(mean[0], cov[0], *r)


def forecast_from_filter(model: StateSpaceModel, r: FilterResult, steps: int) -> ForecastResult:
    return forecast(model, GaussianState(r.filtered_states[-1], r.filtered_covariances[-1]), steps)


def forecast_from_smoother(model: StateSpaceModel, r: SmootherResult, steps: int) -> ForecastResult:
    return forecast(model, GaussianState(r.smoothed_states[-1], r.smoothed_covariances[-1]), steps)


def fit_batch(model: StateSpaceModel, batch: object) -> Moments:
    """(S, T[, m]) arrays."""
    y = np.asarray(batch, float)
    return kalman_scan(model, y[..., None] if y.ndim == 2 else y)


def forecast_batch(model: StateSpaceModel, batch: object, steps: int) -> ForecastResult:
    m = fit_batch(model, batch)
    each = [forecast(model, GaussianState(a, c), steps) for a, c in zip(m.filt_mean[:, -1], m.filt_cov[:, -1], strict=True)]
    return ForecastResult(*(np.stack([e[k] for e in each]) for k in range(4)))


class KalmanFilter:
    def predict(self, state: GaussianState, model: StateSpaceModel, u: object = None) -> GaussianState:
        mean, cov = kalman_predict(state.mean[None], state.cov[None], model, None if u is None else np.atleast_1d(np.asarray(u, float))[None])
        return GaussianState(mean[0], cov[0])

    def update(self, predicted: GaussianState, observation: object, model: StateSpaceModel) -> GaussianState:
        return update(predicted, observation, model)[0]

    def scan(self, model: StateSpaceModel, observations: object, initial_state: GaussianState | None = None, inputs: object = None) -> FilterResult:
        return kalman_filter(model, observations, initial_state, inputs)


def update(predicted: GaussianState, observation: object, model: StateSpaceModel) -> tuple[GaussianState, float]:
    mean, cov, _, _, ll = kalman_update(predicted.mean[None], predicted.cov[None], np.atleast_1d(np.asarray(observation, float))[None], model)
    return GaussianState(mean[0], cov[0]), float(ll[0])


class ExtendedKalmanFilter:
    def predict(self, state: GaussianState, model: NonlinearSSM) -> GaussianState:
        return ekf_predict(state, model)

    def update(self, predicted: GaussianState, observation: object, model: NonlinearSSM) -> GaussianState:
        return ekf_update(predicted, np.asarray(observation, float), model)[0]

    def scan(self, model: NonlinearSSM, observations: object, initial_state: GaussianState | None = None) -> FilterResult:
        return ekf_filter(model, observations, initial_state)


class UnscentedKalmanFilter:
    def __init__(self, alpha: float = 1e-3, beta: float = 2.0, kappa: float = 0.0, sigma: str = "rows") -> None:
        self.alpha, self.beta, self.kappa, self.sigma = alpha, beta, kappa, sigma

    def _weights(self, model: NonlinearSSM) -> SigmaWeights:
        return sigma_weights(model.state_dim, self.alpha, self.beta, self.kappa)

    def predict(self, state: GaussianState, model: NonlinearSSM) -> GaussianState:
        return ukf_predict(state, model, self._weights(model), self.sigma)

    def update(self, predicted: GaussianState, observation: object, model: NonlinearSSM) -> GaussianState:
        return ukf_update(predicted, np.asarray(observation, float), model, self._weights(model), self.sigma)[0]

    def scan(self, model: NonlinearSSM, observations: object, initial_state: GaussianState | None = None) -> FilterResult:
        return ukf_filter(model, observations, initial_state, alpha=self.alpha, beta=self.beta, kappa=self.kappa, sigma=self.sigma)


class RTSSmoother:
    def smooth(self, model: StateSpaceModel, filter_result: FilterResult) -> SmootherResult:
        return rts_smooth(model, filter_result)
