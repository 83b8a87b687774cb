"""Models, kernels, diagnostics and estimation on arrays, against published numbers and plain recursions."""

from __future__ import annotations

import math
import pickle

import numpy as np
import pytest

from fjordline.functions import diagnostics as dg
from fjordline.functions import estimation as es
from fjordline.functions import kernels as k
from fjordline.plans import model as md
from fjordline.sources import datasets

NILE = datasets.values("nile")


def level(w, v):
    return md.StateSpaceModel([[1.0]], [[1.0]], [[v]], [[w]])


def test_components_have_their_matrices():
    m = md.LocalLevel(2.0, 3.0)
    assert (m.W[0, 0], m.V[0, 0], m.state_dim, m.obs_dim) == (4.0, 9.0, 1, 1)
    t = md.LocalLinearTrend(1.0, 0.5, 2.0)
    assert t.G.tolist() == [[1, 1], [0, 1]] and t.F.tolist() == [[1, 0]] and np.diag(t.W).tolist() == [1.0, 0.25]
    s = md.Seasonal(4, 0.3)
    assert s.G.tolist() == [[-1, -1, -1], [1, 0, 0], [0, 1, 0]] and s.W[0, 0] == 0.09 and s.W.sum() == 0.09
    f = md.Seasonal(12, 0.2, form="fourier")
    assert f.state_dim == 11 and np.allclose(f.W, 0.04 * np.eye(11)) and f.F[0].tolist() == [1, 0] * 5 + [1] and f.G[10, 10] == -1
    assert np.allclose(f.G[:2, :2], [[math.cos(math.pi / 6), math.sin(math.pi / 6)], [-math.sin(math.pi / 6), math.cos(math.pi / 6)]])
    assert np.allclose(np.linalg.matrix_power(f.G, 12), np.eye(11)) and md.Seasonal(7, form="fourier").state_dim == 6
    with pytest.raises(ValueError, match="Unknown seasonal form"):
        md.Seasonal(4, form="other")
    a = md.Autoregressive(3, [0.5, 0.2, 0.1], 2.0)
    assert a.G[0].tolist() == [0.5, 0.2, 0.1] and a.G[1].tolist() == [1, 0, 0] and a.W[0, 0] == 4.0
    assert md.Autoregressive(2).G[0].tolist() == [0, 0]
    c = md.Cycle(10.0, 0.9, 2.0)
    assert np.allclose(np.linalg.det(c.G), 0.81) and np.allclose(c.W, 4 * np.eye(2))
    r = md.Regression(3, 0.1, 1.0)
    assert r.F.tolist() == [[1, 1, 1]] and np.allclose(r.W, 0.01 * np.eye(3))


def test_superposition():
    total = md.LocalLinearTrend() + md.Seasonal(12, sigma_obs=2.0) + md.Cycle(5.0)
    assert total.state_dim == 15 and total.V[0, 0] == 5.0 and total.F[0].tolist() == [1, 0, 1, *[0] * 10, 1, 0]
    assert total.G[0, 2] == 0 and total.G[2, 2] == -1
    one = md.StateSpaceModel([[1]], [[1]], [[1]], [[1]], [[2.0]])
    assert (one + md.LocalLevel()).B.tolist() == [[2.0], [0.0]] and (md.LocalLevel() + one).B.tolist() == [[0.0], [2.0]]
    assert (one + one).B.tolist() == [[2, 0], [0, 2]] and (md.LocalLevel() + md.LocalLevel()).B is None
    with pytest.raises(ValueError):
        md.LocalLevel() + md.StateSpaceModel(np.eye(2), np.eye(2), np.eye(2), np.eye(2))


def test_model_values():
    m = md.LocalLinearTrend() + md.LocalLevel()
    assert repr(m) == "StateSpaceModel(state_dim=3, obs_dim=1)"
    assert repr(md.StateSpaceModel([[1]], [[1]], [[1]], [[1]], [[1, 2]])) == "StateSpaceModel(state_dim=1, obs_dim=1, input_dim=2)"
    for other in (pickle.loads(pickle.dumps(m)), md.StateSpaceModel.from_json(m.to_json())):
        assert np.array_equal(other.G, m.G) and np.array_equal(other.V, m.V) and other.B is None
    start = m.initial_state()
    assert start.mean.tolist() == [0, 0, 0] and np.array_equal(start.cov, 1e6 * np.eye(3)) and start.dim == 3
    with pytest.raises(AttributeError):
        start.mean = 1
    with pytest.raises(ValueError):
        md.StateSpaceModel([[1, 1]], [[1]], [[1]], [[1]])
    assert repr(md.NonlinearSSM(lambda x: x, lambda x: x, np.eye(2), [[1]], 2, 1)) == "NonlinearSSM(state_dim=2, obs_dim=1)"
    assert isinstance(k.KalmanFilter(), md.FilterProtocol) and isinstance(k.RTSSmoother(), md.SmootherProtocol) and not isinstance(m, md.FilterProtocol)


def test_steps():
    f, m = k.KalmanFilter(), level(1.0, 1.0)
    p = f.predict(md.GaussianState([5.0], [[2.0]]), m)
    assert (p.mean[0], p.cov[0, 0]) == (5.0, 3.0)
    c = md.StateSpaceModel([[1]], [[1]], [[1]], [[1]], [[2.0]])
    assert f.predict(md.GaussianState([0.0], [[1.0]]), c, [3.0]).mean[0] == 6.0
    state, ll = k.update(md.GaussianState([3.0], [[2.0]]), [math.nan], m)
    assert (state.mean[0], state.cov[0, 0], ll) == (3.0, 2.0, 0.0)


@pytest.mark.parametrize(
    ("w", "v", "ll", "first", "last", "smooth", "resid", "q", "aic", "gaps"),
    [
        (1469.1, 15099, -640.9895845971647, (1103.36473474, 14874.73583019), (798.37029261, 4032.15794181), (1107.21042093, 4015.98859588), (-0.0695336366459, 0.9987173969858), (14.1084542339, 0.1681019094), 1283.9791691943, -623.2824964590758),
        (1600, 14400, -641.0169566225082, (1104.12598425, 14195.90551181), (793.62467553, 4066.21002424), (1107.70516889, 4049.76911791), (-0.0674581328684, 1.0122941524772), (14.0060158788, 0.1727173819), 1284.0339132450, -623.3583790496402),
    ],
)
def test_nile(w, v, ll, first, last, smooth, resid, q, aic, gaps):
    m = level(w, v)
    r = k.kalman_filter(m, NILE)
    assert r.log_likelihood == pytest.approx(ll, rel=1e-12)
    s = k.rts_smooth(m, r)
    for row, want, got in ((0, first, r), (-1, last, r)):
        assert (got.filtered_states[row, 0], got.filtered_covariances[row, 0, 0]) == pytest.approx(want, rel=1e-9)
    assert (s.smoothed_states[0, 0], s.smoothed_covariances[0, 0, 0]) == pytest.approx(smooth, rel=1e-9)
    assert np.array_equal(s.smoothed_states[-1], r.filtered_states[-1]) and (s.smoothed_covariances <= r.filtered_covariances + 1e-9).all()
    z = dg.standardized_residuals(r, m)
    assert (z.mean(), z.std()) == pytest.approx(resid, rel=1e-9)
    assert dg.ljung_box(z) == pytest.approx(q, rel=1e-8)
    assert dg.aic(r.log_likelihood, 1) == pytest.approx(aic, rel=1e-12)
    y = NILE.copy()
    y[[10, 20, 30]] = math.nan
    assert k.kalman_filter(m, y).log_likelihood == pytest.approx(gaps, rel=1e-12)


def test_nile_forecast():
    m = md.local_level(38.0, 123.0)
    r = k.kalman_filter(m, NILE)
    f = k.forecast_from_filter(m, r, 10)
    low, high = k.confidence_bands(f.mean, f.covariance)
    assert np.allclose(f.mean, 799.0573591674556) and (low[0, 0], high[0, 0]) == pytest.approx((517.8832219769, 1080.2314963580))
    assert (low[9, 0], high[9, 0]) == pytest.approx((439.9160300802, 1158.1986882547))
    again = k.forecast_from_smoother(m, k.rts_smooth(m, r), 10)
    assert np.array_equal(again.mean, f.mean) and (np.diff(f.covariance[:, 0, 0]) > 0).all()
    assert np.allclose(k.forecast(md.local_level(40, 120), md.GaussianState([850.0], [[5000.0]]), 10).mean, 850)
    table = np.array([[1.0, 4.0], [9.0, 16.0]])
    assert np.allclose(k.confidence_bands(np.zeros((2, 2)), table, kind="var")[1] / k.z_score(0.95), [[1, 2], [3, 4]])


def _random_model(rng, n, m, p=0):
    spd = lambda s: (lambda a: a @ a.T + np.eye(s))(rng.normal(size=(s, s)))
    return md.StateSpaceModel(rng.normal(size=(m, n)), 0.7 * np.linalg.qr(rng.normal(size=(n, n)))[0], spd(m), spd(n), rng.normal(size=(n, p)) if p else None)


@pytest.mark.parametrize(("n", "m", "p"), [(1, 1, 0), (2, 1, 3), (3, 2, 0), (4, 3, 2)])
def test_filter_and_smoother_are_the_joint_gaussian(n, m, p):
    """Against conditioning the joint normal of all states and observations, gaps included."""
    rng = np.random.default_rng(n * 10 + m)
    model, steps = _random_model(rng, n, m, p), 6
    prior = md.GaussianState(rng.normal(size=n), np.eye(n) * 2)
    y = rng.normal(size=(steps, m)) * 2
    y[2] = math.nan
    u = rng.normal(size=(steps, p)) if p else None
    means, covs = [], {}
    mean, var = prior.mean, prior.cov
    for t in range(steps):
        mean = model.G @ mean + (model.B @ u[t] if p else 0)
        var = model.G @ var @ model.G.T + model.W
        means.append(mean)
        covs[t, t] = var
        for s in range(t):
            covs[t, s] = model.G @ covs[t - 1, s]
            covs[s, t] = covs[t, s].T
    big = np.block([[covs[a, b] for b in range(steps)] for a in range(steps)])
    mu = np.concatenate(means)
    moments = k.kalman_scan(model, y[None], prior, None if u is None else u[None])
    smooth = k.rts(model, moments)

    def posterior(upto):
        seen = [t for t in range(upto) if not np.isnan(y[t]).any()]
        h = np.zeros((len(seen) * m, steps * n))
        for i, t in enumerate(seen):
            h[i * m : (i + 1) * m, t * n : (t + 1) * n] = model.F
        s = h @ big @ h.T + np.kron(np.eye(len(seen)), model.V)
        e = np.concatenate([y[t] for t in seen]) - h @ mu
        gain = np.linalg.solve(s, h @ big).T
        return mu + gain @ e, big - gain @ h @ big, float(-0.5 * (len(e) * k.LN_2PI + np.linalg.slogdet(s)[1] + e @ np.linalg.solve(s, e)))

    for t in range(steps):
        at = slice(t * n, (t + 1) * n)
        mean, var, _ = posterior(t + 1)
        assert np.allclose(moments.filt_mean[0, t], mean[at]) and np.allclose(moments.filt_cov[0, t], var[at, at])
    mean, var, ll = posterior(steps)
    assert np.allclose(smooth[0][0].ravel(), mean) and moments.ll.sum() == pytest.approx(ll)
    assert all(np.allclose(smooth[1][0, t], var[t * n : (t + 1) * n, t * n : (t + 1) * n]) for t in range(steps))


def test_gains_computed_once_give_the_same():
    rng = np.random.default_rng(4)
    model, y = _random_model(rng, 3, 2), rng.normal(size=(5, 20, 2))
    a, b = k.kalman_scan(model, y), k.complete_scan(model, y, k.steady_plan(model, 20))
    assert all(np.allclose(u, v) for u, v in zip(a, b, strict=True))


def test_batch_is_single():
    rng = np.random.default_rng(5)
    y, m = 800 + 100 * rng.normal(size=(4, 40)), md.local_level(38, 123)
    got = k.fit_batch(m, y)
    for s in range(4):
        assert np.allclose(got.filt_mean[s], k.kalman_filter(m, y[s]).filtered_states)
    f = k.forecast_batch(m, y, 5)
    assert f.mean.shape == (4, 5, 1) and np.allclose(f.mean[2], k.forecast_from_filter(m, k.kalman_filter(m, y[2]), 5).mean)


def test_singular_is_nan_not_an_error():
    flat = md.StateSpaceModel(np.ones((2, 1)), [[1.0]], np.zeros((2, 2)), [[0.0]])
    assert np.isnan(k.kalman_scan(flat, np.ones((1, 3, 2))).filt_mean).any()


def _wave(q=0.5, r=1.0):
    return md.NonlinearSSM(lambda x: x + 0.1 * np.sin(x), lambda x: x, [[q]], [[r]], 1, 1)


def test_nonlinear_filters_equal_the_linear_one_on_linear_models():
    rng = np.random.default_rng(6)
    g = np.array([[0.9, 0.2], [0.0, 0.8]])
    linear = md.StateSpaceModel(np.eye(2), g, np.eye(2), 0.1 * np.eye(2))
    model = md.NonlinearSSM(lambda x: g @ x, lambda x: x, 0.1 * np.eye(2), np.eye(2), 2, 2)
    y = rng.normal(size=(30, 2))
    y[4, 1] = math.nan
    prior = md.GaussianState([0, 0], 10 * np.eye(2))
    want = k.kalman_filter(linear, y, prior)
    for got in (k.ekf_filter(model, y, prior), k.ukf_filter(model, y, prior, alpha=1.0, sigma="columns")):
        assert np.allclose(got.filtered_states, want.filtered_states, atol=1e-6) and got.log_likelihood == pytest.approx(want.log_likelihood, abs=1e-6)


def test_sigma_points():
    w = k.sigma_weights(3, 1.0, 2.0, 0.0)
    assert w.lam == 0 and w.wm.sum() == pytest.approx(1) and w.wc[0] == 2.0
    c = np.array([[1, 0.3], [0.3, 0.5]])
    w = k.sigma_weights(2, 1.0)
    for kind, want in (("columns", c), ("rows", np.array([[1.09, 0.192], [0.192, 0.41]]))):
        p = k.sigma_points(md.GaussianState([1, 2], c), w.lam, kind)
        assert np.allclose(w.wm @ p, [1, 2])
        assert np.allclose(((p - [1, 2]).T * w.wm) @ (p - [1, 2]), want, atol=1e-3)


def test_nonlinear_tracking_and_jacobian():
    rng = np.random.default_rng(7)
    x, truth = 5.0, []
    for _ in range(200):
        x = 0.95 * x + 0.1 * math.sin(x) + 0.5 * rng.normal()
        truth.append(x)
    y = np.array(truth) + rng.normal(size=200)
    model = md.NonlinearSSM(lambda v: 0.95 * v + 0.1 * np.sin(v), lambda v: v, [[0.25]], [[1.0]], 1, 1)
    for run in (k.ekf_filter, k.ukf_filter):
        got = run(model, y, md.GaussianState([5.0], [[1.0]]))
        assert np.corrcoef(got.filtered_states[:, 0], truth)[0, 1] > 0.7
    polar = lambda v: np.array([np.sqrt(v[0] ** 2 + v[1] ** 2), np.arctan2(np.real(v[1]), np.real(v[0]))])
    j = k.jacobian(polar, np.array([3.0, 4.0]))
    assert np.allclose(j, [[0.6, 0.8], [-0.16, 0.12]], atol=1e-6)
    e = k.ExtendedKalmanFilter()
    p = e.predict(md.GaussianState([0.5], [[2.0]]), _wave())
    assert p.cov[0, 0] == pytest.approx((1 + 0.1 * math.cos(0.5)) ** 2 * 2 + 0.5)
    u = k.UnscentedKalmanFilter(alpha=1.0)
    assert u.update(u.predict(md.GaussianState([0.5], [[2.0]]), _wave()), [1.0], _wave()).cov[0, 0] > 0


def test_diagnostics():
    rng = np.random.default_rng(8)
    x = rng.normal(size=500)
    r = dg.acf(x, 20)
    assert r[0] == 1 and np.abs(r[1:]).max() < 0.2 and dg.acf(x[:5], 9)[5:].tolist() == [0] * 5
    ar = np.zeros(2000)
    for t in range(1, 2000):
        ar[t] = 0.8 * ar[t - 1] + rng.normal()
    p = dg.pacf(ar, 10)
    assert p[0] == 1 and abs(p[1] - 0.8) < 0.05 and np.abs(p[2:]).max() < 0.1 and dg.pacf(ar, 0).tolist() == [1.0]
    rr = dg.acf(ar, 4)
    toeplitz = np.array([[rr[abs(i - j)] for j in range(4)] for i in range(4)])
    assert dg.pacf(ar, 4)[4] == pytest.approx(np.linalg.solve(toeplitz, rr[1:])[-1])
    assert dg.ljung_box(x)[1] > 0.01 and dg.ljung_box(ar)[1] < 1e-6
    with pytest.raises(ValueError):
        dg.ljung_box(x[:10], 10)
    assert dg.chi2_sf(3.84145882, 1) == pytest.approx(0.05) and dg.chi2_sf(18.3070381, 10) == pytest.approx(0.05) and dg.chi2_sf(7.8147279, 3) == pytest.approx(0.05)


def test_transforms():
    x = np.array([-2, -1, 0, 1, 5.0])
    assert np.allclose(es.inverse_softplus(es.softplus(x)), x) and es.softplus(0.0) == pytest.approx(math.log(2)) and es.inverse_softplus(800.0) == 800


def test_em():
    start = level(1000.0, 10000.0)
    r = es.fit_em(NILE, start, 200, 1e-4)
    assert (r.n_iterations, r.converged) == (28, True)
    assert (r.model.W[0, 0], r.model.V[0, 0]) == pytest.approx((14891.638, 7482.158), abs=1e-3)
    assert (r.log_likelihood_history[0], r.log_likelihood, max(r.log_likelihood_history)) == pytest.approx((-645.7298, -647.8162, -641.7090), abs=1e-4)
    far = es.fit_em(NILE, level(100.0, 50000.0), 30, 1e-6)
    assert not far.converged and (far.model.W[0, 0], far.model.V[0, 0]) == pytest.approx((14891.372, 7481.011), abs=1e-3)
    exact = es.fit_em(NILE, start, 400, 1e-6, "exact")
    assert min(np.diff(exact.log_likelihood_history)) > -1e-9 and exact.log_likelihood > -641.0
    with pytest.raises(ValueError):
        es.em_step(start, NILE[:, None], "other")


def test_mle():
    r = es.fit_mle(lambda p: md.local_level(math.exp(p[0]), math.exp(p[1])), NILE, [math.log(1000) / 2, math.log(10000) / 2])
    assert r.converged and r.log_likelihood == pytest.approx(-640.98957, abs=1e-4) and 500 < r.model.W[0, 0] < 5000 and 5000 < r.model.V[0, 0] < 30000
    best = es.lbfgs(lambda x: float((x[0] - 3) ** 2 + 10 * (x[1] + 1) ** 2 + 2), [0.0, 0.0])
    assert np.allclose(best.x, [3, -1], atol=1e-4) and best.converged


def test_datasets(tmp_path):
    want = {"nile": (100, 456, 1370, 919.35), "airline": (144, 104, 622, 280.29861), "lynx": (114, 39, 6991, 1538.01754), "temperature": (144, -0.48, 0.72, 0.00847)}
    for name, (n, low, high, mean) in want.items():
        v = datasets.values(name)
        assert (len(v), v.min(), v.max()) == (n, low, high) and v.mean() == pytest.approx(mean, abs=1e-5)
    with pytest.raises(ValueError):
        datasets.values("gdp")
    (tmp_path / "g.csv").write_text("1.5\n-2\n3\n")
    assert datasets.values("gdp", str(tmp_path / "g.csv")).tolist() == [1.5, -2.0, 3.0]
