"""State-space models as immutable NumPy values on the driver; they travel to tasks by pickling.

    x_t = G x_{t-1} + B u_t + w_t,  w ~ N(0, W)        y_t = F x_t + v_t,  v ~ N(0, V)
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, NamedTuple, Protocol, runtime_checkable

import numpy as np

#: Variance of each state before any observation, unless a prior is given.
DIFFUSE = 1e6


def _matrix(name: str, value: Any, rows: int | None = None, cols: int | None = None) -> np.ndarray:
    out = np.atleast_2d(np.asarray(value, float))
    if out.ndim != 2 or (rows is not None and out.shape[0] != rows) or (cols is not None and out.shape[1] != cols):
        raise ValueError(f"{name} has shape {out.shape}; expected ({rows or 'any'}, {cols or 'any'})")
    out.setflags(write=False)
    return out


class GaussianState:
    """A Gaussian belief about the state: mean (n,), cov (n, n)."""

    __slots__ = ("cov", "mean")

    def __init__(self, mean: Any, cov: Any) -> None:
        object.__setattr__(self, "mean", np.atleast_1d(np.asarray(mean, float)))
        n = self.mean.shape[-1]
        object.__setattr__(self, "cov", np.asarray(cov, float).reshape(n, n))

    def __setattr__(self, name: str, value: Any) -> None:
        raise AttributeError("GaussianState is immutable")

    def __reduce__(self):
        return GaussianState, (self.mean, self.cov)

    @property
    def dim(self) -> int:
        return self.mean.shape[-1]


def default_state(n: int, mean: Any = None, cov: Any = None) -> GaussianState:
    return GaussianState(np.zeros(n) if mean is None else mean, np.eye(n) * DIFFUSE if cov is None else cov)


def block_diag(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((a.shape[0] + b.shape[0], a.shape[1] + b.shape[1]))
    out[: a.shape[0], : a.shape[1]] = a
    out[a.shape[0] :, a.shape[1] :] = b
    return out


@dataclass(frozen=True, eq=False)
class StateSpaceModel:
    """A linear Gaussian model; `+` superposes two."""

    observation_matrix: np.ndarray
    system_matrix: np.ndarray
    obs_cov: np.ndarray
    evolution_cov: np.ndarray
    input_matrix: np.ndarray | None = None

    def __post_init__(self) -> None:
        put = lambda k, v: object.__setattr__(self, k, v)
        put("system_matrix", _matrix("system_matrix", self.system_matrix))
        n = self.system_matrix.shape[0]
        put("system_matrix", _matrix("system_matrix", self.system_matrix, n, n))
        put("observation_matrix", _matrix("observation_matrix", self.observation_matrix, None, n))
        m = self.observation_matrix.shape[0]
        put("obs_cov", _matrix("obs_cov", self.obs_cov, m, m))
        put("evolution_cov", _matrix("evolution_cov", self.evolution_cov, n, n))
        if self.input_matrix is not None:
            put("input_matrix", _matrix("input_matrix", self.input_matrix, n))

    F = property(lambda self: self.observation_matrix)
    G = property(lambda self: self.system_matrix)
    V = property(lambda self: self.obs_cov)
    W = property(lambda self: self.evolution_cov)
    B = property(lambda self: self.input_matrix)
    state_dim = property(lambda self: self.system_matrix.shape[-1])
    obs_dim = property(lambda self: self.observation_matrix.shape[-2])
    input_dim = property(lambda self: 0 if self.input_matrix is None else self.input_matrix.shape[-1])

    def initial_state(self, mean: Any = None, cov: Any = None) -> GaussianState:
        return default_state(self.state_dim, mean, cov)

    def __add__(self, other: StateSpaceModel) -> StateSpaceModel:
        if not isinstance(other, StateSpaceModel):
            return NotImplemented
        if self.obs_dim != other.obs_dim:
            raise ValueError(f"models observe {self.obs_dim} and {other.obs_dim} values")
        inputs = None
        if self.input_dim or other.input_dim:
            inputs = block_diag(*(m.B if m.B is not None else np.zeros((m.state_dim, 0)) for m in (self, other)))
        return StateSpaceModel(np.hstack([self.F, other.F]), block_diag(self.G, other.G), self.V + other.V, block_diag(self.W, other.W), inputs)

    def __repr__(self) -> str:
        tail = f", input_dim={self.input_dim}" if self.B is not None else ""
        return f"StateSpaceModel(state_dim={self.state_dim}, obs_dim={self.obs_dim}{tail})"

    def to_json(self) -> str:
        return json.dumps({k: None if v is None else v.tolist() for k, v in zip("FGVWB", (self.F, self.G, self.V, self.W, self.B), strict=True)})

    @classmethod
    def from_json(cls, text: str) -> StateSpaceModel:
        d = json.loads(text)
        return cls(d["F"], d["G"], d["V"], d["W"], d["B"])


@dataclass(frozen=True, eq=False)
class NonlinearSSM:
    """x_t = f(x_{t-1}) + w, y_t = h(x_t) + v.  Jacobians are optional; without them they are taken numerically."""

    transition_fn: Callable[[np.ndarray], np.ndarray]
    observation_fn: Callable[[np.ndarray], np.ndarray]
    transition_cov: np.ndarray
    observation_cov: np.ndarray
    state_dim: int
    obs_dim: int
    transition_jacobian: Callable[[np.ndarray], np.ndarray] | None = None
    observation_jacobian: Callable[[np.ndarray], np.ndarray] | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "transition_cov", _matrix("transition_cov", self.transition_cov, self.state_dim, self.state_dim))
        object.__setattr__(self, "observation_cov", _matrix("observation_cov", self.observation_cov, self.obs_dim, self.obs_dim))

    Q = property(lambda self: self.transition_cov)
    R = property(lambda self: self.observation_cov)
    f = property(lambda self: self.transition_fn)
    h = property(lambda self: self.observation_fn)

    def initial_state(self, mean: Any = None, cov: Any = None) -> GaussianState:
        return default_state(self.state_dim, mean, cov)

    def __repr__(self) -> str:
        return f"NonlinearSSM(state_dim={self.state_dim}, obs_dim={self.obs_dim})"


class FilterResult(NamedTuple):
    """One series' filter: moments by time, total log-likelihood, the observations (T, m)."""

    filtered_states: np.ndarray
    filtered_covariances: np.ndarray
    predicted_states: np.ndarray
    predicted_covariances: np.ndarray
    log_likelihood: float
    observations: np.ndarray


class SmootherResult(NamedTuple):
    smoothed_states: np.ndarray
    smoothed_covariances: np.ndarray
    filtered_states: np.ndarray
    filtered_covariances: np.ndarray
    predicted_states: np.ndarray
    predicted_covariances: np.ndarray
    log_likelihood: float
    observations: np.ndarray


class ForecastResult(NamedTuple):
    mean: np.ndarray
    covariance: np.ndarray
    state_mean: np.ndarray
    state_covariance: np.ndarray


@runtime_checkable
class FilterProtocol(Protocol):
    def predict(self, state, model): ...
    def update(self, predicted, observation, model): ...
    def scan(self, model, observations): ...


@runtime_checkable
class SmootherProtocol(Protocol):
    def smooth(self, model, filter_result): ...


def local_level(sigma_level: float = 1.0, sigma_obs: float = 1.0) -> StateSpaceModel:
    """A random walk and noise."""
    return StateSpaceModel([[1.0]], [[1.0]], [[sigma_obs**2]], [[sigma_level**2]])


def local_linear_trend(sigma_level: float = 1.0, sigma_slope: float = 0.1, sigma_obs: float = 1.0) -> StateSpaceModel:
    """Level and slope."""
    return StateSpaceModel([[1.0, 0.0]], [[1.0, 1.0], [0.0, 1.0]], [[sigma_obs**2]], np.diag([sigma_level**2, sigma_slope**2]))


def companion(first: Any) -> np.ndarray:
    """A first row above a shifted identity."""
    first = np.asarray(first, float)
    return np.vstack([first, np.eye(len(first))[:-1]])


def _first_noise(n: int, variance: float) -> np.ndarray:
    out = np.zeros((n, n))
    out[0, 0] = variance
    return out


def rotation(angle: float, damping: float = 1.0) -> np.ndarray:
    c, s = np.cos(angle), np.sin(angle)
    return damping * np.array([[c, s], [-s, c]])


def seasonal(period: int, sigma_seasonal: float = 0.1, sigma_obs: float = 0.0, form: str = "dummy") -> StateSpaceModel:
    """A pattern of `period` steps that sums to zero: period - 1 dummies, or harmonics."""
    if period < 2:
        raise ValueError("period must be at least 2")
    n = period - 1
    if form == "dummy":
        return StateSpaceModel(np.eye(n)[:1], companion(np.full(n, -1.0)), [[sigma_obs**2]], _first_noise(n, sigma_seasonal**2))
    if form != "fourier":
        raise ValueError(f"Unknown seasonal form: {form!r}. Use 'dummy' or 'fourier'.")
    system, observed = np.zeros((0, 0)), []
    for harmonic in range(1, period // 2 + 1):
        half = 2 * harmonic == period
        system = block_diag(system, np.array([[-1.0]]) if half else rotation(2 * np.pi * harmonic / period))
        observed += [1.0] if half else [1.0, 0.0]
    return StateSpaceModel([observed], system, [[sigma_obs**2]], np.eye(n) * sigma_seasonal**2)


def regression(n_regressors: int, sigma_coeff: float = 0.0, sigma_obs: float = 0.0) -> StateSpaceModel:
    """Drifting coefficients.  F is ones; operators put a design column in its place (see SeriesSpec.x)."""
    return StateSpaceModel(np.ones((1, n_regressors)), np.eye(n_regressors), [[sigma_obs**2]], np.eye(n_regressors) * sigma_coeff**2)


def autoregressive(order: int, coefficients: Any = None, sigma_ar: float = 1.0, sigma_obs: float = 0.0) -> StateSpaceModel:
    phi = np.zeros(order) if coefficients is None else np.asarray(coefficients, float)
    if phi.shape != (order,):
        raise ValueError(f"{order} coefficients expected, {phi.shape} given")
    return StateSpaceModel(np.eye(order)[:1], companion(phi), [[sigma_obs**2]], _first_noise(order, sigma_ar**2))


def cycle(period: float, damping: float = 1.0, sigma_cycle: float = 1.0, sigma_obs: float = 0.0) -> StateSpaceModel:
    return StateSpaceModel([[1.0, 0.0]], rotation(2 * np.pi / period, damping), [[sigma_obs**2]], np.eye(2) * sigma_cycle**2)


LocalLevel, LocalLinearTrend, Seasonal, Regression, Autoregressive, Cycle = local_level, local_linear_trend, seasonal, regression, autoregressive, cycle
