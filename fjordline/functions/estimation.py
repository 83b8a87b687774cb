"""Parameters of one series or of many that share a model: maximum likelihood and EM."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np

from fjordline.functions.kernels import kalman_filter, kalman_scan, rows_of, rts
from fjordline.plans.model import FilterResult, StateSpaceModel


def softplus(x: object) -> np.ndarray:
    return np.logaddexp(x, 0.0)


def inverse_softplus(y: object) -> np.ndarray:
    y = np.asarray(y, float)
    return np.where(y > 30, y, np.log(np.expm1(np.minimum(y, 30))))


class Optimum(NamedTuple):
    x: np.ndarray
    value: float
    n_iterations: int
    converged: bool


def numeric_gradient(fn: Callable[[np.ndarray], float], x: np.ndarray) -> np.ndarray:
    step = 1e-5 * np.maximum(1.0, np.abs(x))
    return np.array([(fn(x + step[k] * e) - fn(x - step[k] * e)) / (2 * step[k]) for k, e in enumerate(np.eye(len(x)))])


def lbfgs(fn: Callable[[np.ndarray], float], x: object, gradient: Callable[[np.ndarray], np.ndarray] | None = None, max_iter: int = 500, tol: float = 1e-6, memory: int = 8) -> Optimum:
    """Limited-memory BFGS (Nocedal, 1980) with backtracking.  Stops when the value or the gradient settles to tol."""
    grad = gradient or (lambda v: numeric_gradient(fn, v))
    x = np.asarray(x, float).copy()
    value, g = fn(x), grad(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for iteration in range(max_iter):
        if np.abs(g).max(initial=0.0) < tol:
            return Optimum(x, value, iteration, True)
        d, alphas = -g, []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            alphas.append(a)
            d = d - a * y
        d = d * ((pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.linalg.norm(g)))
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        slope = g @ d
        if not slope < 0:
            d, slope, pairs = -g, -(g @ g), []
        size = 1.0
        for _ in range(40):
            after = fn(x + size * d)
            if np.isfinite(after) and after <= value + 1e-4 * size * slope:
                break
            size *= 0.5
        else:
            return Optimum(x, value, iteration, bool(pairs))
        step = size * d
        new_g = grad(x + step)
        if step @ (new_g - g) > 1e-12:
            pairs = [*pairs, (step, new_g - g)][-memory:]
        done = abs(value - after) <= tol * 1e-3 * max(abs(value), abs(after), 1.0)
        x, value, g = x + step, after, new_g
        if done:
            return Optimum(x, value, iteration + 1, True)
    return Optimum(x, value, max_iter, False)


class MLEResult(NamedTuple):
    model: StateSpaceModel
    log_likelihood: float
    params: np.ndarray
    n_iterations: int
    converged: bool
    filter_result: FilterResult


def fit_mle(model_fn: Callable[[np.ndarray], StateSpaceModel], observations: object, init_params: object, max_iter: int = 500, tol: float = 1e-6) -> MLEResult:
    """The parameters at which the filter's likelihood of one series is largest.  Missing rows are skipped."""
    y = rows_of(observations)[None]

    def loss(p: np.ndarray) -> float:
        value = -float(kalman_scan(model_fn(p), y).ll.sum())
        return value if np.isfinite(value) else 1e300

    best = lbfgs(loss, init_params, max_iter=max_iter, tol=tol)
    model = model_fn(best.x)
    return MLEResult(model, -best.value, best.x, best.n_iterations, best.converged, kalman_filter(model, y[0]))


class EMResult(NamedTuple):
    model: StateSpaceModel
    log_likelihood: float
    n_iterations: int
    converged: bool
    log_likelihood_history: list[float]


def em_step(model: StateSpaceModel, y: np.ndarray, m_step: str = "approx") -> tuple[StateSpaceModel, float]:
    """The model after one step from the series y (T, m), and the likelihood before it.

    'approx' leaves the cross-covariance of neighbouring smoothed states out of W, as parity asks, and may lose
    likelihood; 'exact' takes it in (Shumway and Stoffer, 1982) and never does.  Missing rows don't count for V.
    """
    m = kalman_scan(model, y[None])
    mean, cov, gain = (v[0] for v in rts(model, m))
    seen = ~np.isnan(y).any(1)
    rest = y[seen] - mean[seen] @ model.F.T
    v = (rest.T @ rest + model.F @ cov[seen].sum(0) @ model.F.T) / max(int(seen.sum()), 1)
    move = mean[1:] - mean[:-1] @ model.G.T
    w = move.T @ move + cov[1:].sum(0) + model.G @ cov[:-1].sum(0) @ model.G.T
    if m_step == "exact":
        cross = (cov[1:] @ np.swapaxes(gain[:-1], -1, -2)).sum(0)  # of x_t with x_{t-1}
        w = w - cross @ model.G.T - model.G @ cross.T
    elif m_step != "approx":
        raise ValueError(f"Unknown m_step: {m_step!r}. Use 'approx' or 'exact'.")
    w = w / max(len(y) - 1, 1)
    return StateSpaceModel(model.F, model.G, (v + v.T) / 2, (w + w.T) / 2, model.B), float(m.ll.sum())


def fit_em(observations: object, initial_model: StateSpaceModel, max_iter: int = 100, tol: float = 1e-6, m_step: str = "approx") -> EMResult:
    """Steps until the likelihood moves by less than tol; at max_iter the model is one step ahead of the likelihood told."""
    y, model, history = rows_of(observations), initial_model, []
    for i in range(max_iter):
        after, ll = em_step(model, y, m_step)
        history.append(ll)
        if i and abs(history[-1] - history[-2]) < tol:
            return EMResult(model, ll, i + 1, True, history)
        model = after
    return EMResult(model, history[-1] if history else float("nan"), max_iter, False, history)
