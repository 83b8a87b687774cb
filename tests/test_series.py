"""DataFrame operators against the array kernels, each other, and plain pandas."""

from __future__ import annotations

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fjordline.functions import diagnostics as dg
from fjordline.functions import estimation as es
from fjordline.functions import kernels as k
from fjordline.operators import diagnose, plot_data, prepare
from fjordline.operators import series as ops
from fjordline.operators.series import SeriesSpec
from fjordline.plans import fold
from fjordline.plans import model as md
from fjordline.plans.facade import SparkDLM
from fjordline.sources import datasets
from fjordline.streaming.online import filter_stream

LENGTHS = {"a": 40, "b": 40, "c": 7, "d": 1, None: 12}
MODEL = md.local_linear_trend(1.0, 0.3, 2.0) + md.autoregressive(1, [0.5], 1.0)


@pytest.fixture(scope="module")
def truth():
    rng = np.random.default_rng(1)
    out = {}
    for key, n in LENGTHS.items():
        y = np.cumsum(rng.normal(size=n)) + rng.normal(size=n)
        if key in ("b", None):
            y[::5] = math.nan
        out[key] = y
    return out


@pytest.fixture(scope="module")
def frame(spark, truth):
    day = datetime.date(2024, 1, 1)
    rows = [(key, day + datetime.timedelta(days=t), None if math.isnan(v) and t % 2 else float(v), float(t)) for key, y in truth.items() for t, v in enumerate(y)]
    return spark.createDataFrame(rows, "key string, ts date, y double, junk double").repartition(5)


SPEC = SeriesSpec("key")


@pytest.mark.parametrize("stack_rows", [65_536, 10])
def test_filter_and_smooth_rows(frame, truth, stack_rows):
    got = ops.smooth_series(frame, SPEC, MODEL, stack_rows=stack_rows).toPandas()
    assert len(got) == sum(LENGTHS.values())
    for key, y in truth.items():
        own = got[got["key"].isna() if key is None else got["key"] == key].sort_values("t")
        want = k.rts_smooth(MODEL, k.kalman_filter(MODEL, y))
        assert own["t"].tolist() == list(range(1, len(y) + 1)) and own["ts"].is_monotonic_increasing
        for column, value in (("filt_mean", want.filtered_states), ("pred_cov", want.predicted_covariances), ("smooth_mean", want.smoothed_states), ("smooth_cov", want.smoothed_covariances)):
            cells = np.array([np.stack(list(v)) for v in own[column]])
            assert np.allclose(cells, value)
        assert own["ll"].sum() == pytest.approx(want.log_likelihood)


def test_columns_are_pruned_and_outputs_checked(frame):
    plan = ops.filter_series(frame, SPEC, MODEL, outputs=("ll",))._jdf.queryExecution().optimizedPlan().toString()
    assert "junk" not in plan.split("Project")[1]
    assert ops.filter_series(frame, SPEC, MODEL, outputs=("ll",)).columns == ["key", "ts", "t", "y", "ll"]
    with pytest.raises(ValueError):
        ops.filter_series(frame, SPEC, MODEL, outputs=("nope",))
    assert ops.filter_series(frame.where("false"), SPEC, MODEL).count() == 0


def test_expression_route_is_the_kernel_route(frame, truth):
    for model in (md.local_level(1, 2), md.local_linear_trend(1, 0.3, 2), md.cycle(9, 0.9, 1, 1), md.seasonal(4, 1, 2), MODEL):
        got = {r["key"]: r for r in fold.final_state(frame, ["key"], model).collect()}
        for key, y in truth.items():
            r = k.kalman_filter(model, y)
            n = model.state_dim
            assert np.allclose([got[key][f"m{i}"] for i in range(n)], r.filtered_states[-1])
            assert np.allclose([got[key][f"c{i}{j}"] for i in range(n) for j in range(i, n)], r.filtered_covariances[-1][np.triu_indices(n)])
            assert got[key]["ll"] == pytest.approx(r.log_likelihood)
    with pytest.raises(ValueError):
        fold.final_state(frame, ["key"], md.seasonal(6))
    m = md.StateSpaceModel([[1.0]], [[0.7]], [[2.0]], [[1.5]])
    rows = {(r["key"], r.t): r for r in fold.level_rows(frame, ["key"], m, smooth=True).collect()}
    for key, y in truth.items():
        s = k.rts_smooth(m, k.kalman_filter(m, y))
        assert np.allclose([(rows[key, t + 1].s, rows[key, t + 1].p) for t in range(len(y))], np.stack([s.smoothed_states[:, 0], s.smoothed_covariances[:, 0, 0]], 1))


def test_inputs_and_design_columns(spark):
    rng = np.random.default_rng(2)
    n = 25
    u, x = rng.normal(size=(n, 2)), rng.normal(size=(n, 2))
    y = rng.normal(size=n)
    rows = [("s", t, float(y[t]), *map(float, (*u[t], *x[t]))) for t in range(n)]
    df = spark.createDataFrame(rows, "key string, ts long, y double, u0 double, u1 double, x0 double, x1 double")
    m = md.StateSpaceModel([[1.0]], [[0.9]], [[1.0]], [[0.5]], [[1.0, -2.0]])
    got = ops.last_state(df, SeriesSpec("key", u=("u0", "u1")), m).first()
    want = k.kalman_filter(m, y, inputs=u)
    assert got.mean[0] == pytest.approx(want.filtered_states[-1, 0]) and got.log_likelihood == pytest.approx(want.log_likelihood)
    got = ops.last_state(df, SeriesSpec("key", x=("x0", "x1")), md.regression(2, 0.0, 1.0)).first()
    prior = 1e-6 * np.eye(2)
    assert np.allclose(got.mean, np.linalg.solve(x.T @ x + prior, x.T @ y))


def test_vectors_and_nonlinear(spark, frame, truth):
    rows = frame.withColumn("y2", F.col("y") * 2).withColumn("both", F.array("y", "y2"))
    m = md.StateSpaceModel(np.eye(2), 0.9 * np.eye(2), np.eye(2), np.eye(2))
    a = ops.last_state(rows, SeriesSpec("key", y=("y", "y2")), m).toPandas().set_index("key")
    b = ops.last_state(rows, SeriesSpec("key", y="both"), m).toPandas().set_index("key")
    assert np.allclose(a["log_likelihood"], b["log_likelihood"].reindex(a.index))
    model = md.NonlinearSSM(lambda v: v + 0.1 * np.sin(v), lambda v: v, [[0.5]], [[1.0]], 1, 1)
    for kind, run in (("ekf", k.ekf_filter), ("ukf", k.ukf_filter)):
        got = ops.nonlinear_series(frame, SPEC, model, kind).groupBy("key").agg(F.sum("ll").alias("ll")).collect()
        assert {r["key"]: pytest.approx(r.ll) for r in got} == {key: run(model, y).log_likelihood for key, y in truth.items()}
    with pytest.raises(ValueError):
        ops.nonlinear_series(frame, SPEC, model, "pf")


def test_singular_series_do_not_fail_the_job(spark):
    df = spark.createDataFrame([("s", t, 1.0, 2.0) for t in range(3)], "key string, ts long, y double, z double")
    got = ops.last_state(df, SeriesSpec("key", y=("y", "z")), md.StateSpaceModel(np.ones((2, 1)), [[1.0]], np.zeros((2, 2)), [[0.0]])).first()
    assert got.status == "singular"


def test_forecast_rows(frame, truth):
    got = ops.forecast_series(frame, SPEC, MODEL, 5, freq="D", level=0.8).toPandas()
    for key, y in truth.items():
        own = got[got["key"].isna() if key is None else got["key"] == key].sort_values("h")
        want = k.forecast_from_filter(MODEL, k.kalman_filter(MODEL, y), 5)
        low, high = k.confidence_bands(want.mean, want.covariance, 0.8)
        assert np.allclose(own[["mean", "lower", "upper"]], np.stack([want.mean[:, 0], low[:, 0], high[:, 0]], 1))
        assert own["ts"].tolist() == [datetime.date(2024, 1, 1) + datetime.timedelta(days=len(y) - 1 + h) for h in range(1, 6)]


def test_date_continuation(spark):
    last = pd.Timestamp("2024-02-29")
    df = spark.createDataFrame([(last.date(), h) for h in range(1, 15)], "d date, h int")
    for freq, alias in (("ME", "ME"), ("QE", "QE"), ("YE", "YE")):
        start = {"ME": last, "QE": pd.Timestamp("2024-03-31"), "YE": pd.Timestamp("2023-12-31")}[freq]
        rows = spark.createDataFrame([(start.date(), h) for h in range(1, 15)], "d date, h int")
        got = [r[0] for r in rows.select(ops.continue_dates(F.col("d"), F.col("h"), freq), "h").orderBy("h").collect()]
        assert got == [d.date() for d in pd.date_range(start, periods=15, freq=alias)[1:]]
    assert df.select(ops.continue_dates(F.col("d"), F.col("h"), None).alias("x")).where("x is not null").count() == 0
    with pytest.raises(ValueError):
        ops.continue_dates(F.col("d"), F.col("h"), "fortnight")


def test_diagnostics_rows(frame, truth):
    m = md.local_level(1, 2)
    z = diagnose.residuals(ops.filter_series(frame, SPEC, m))
    acf = {(r["key"], r["lag"]): r["acf"] for r in diagnose.acf(z, ["key"], "t", "resid", 5).collect()}
    box = {r["key"]: (r.lb_q, r.lb_p) for r in diagnose.ljung_box(diagnose.acf(z, ["key"], "t", "resid", 5), ["key"], 5).collect()}
    even = {r["key"]: r.lb_p for r in diagnose.ljung_box(diagnose.acf(z, ["key"], "t", "resid", 4), ["key"], 4).collect()}
    summary = {r["key"]: r for r in diagnose.fit_summary(ops.filter_series(frame, SPEC, m), ["key"], 1).collect()}
    kernel = {r["key"]: r for r in ops.summary_series(frame, SPEC, m, n_lags=5).collect()}
    for key, y in truth.items():
        r = k.kalman_filter(m, y)
        want = dg.standardized_residuals(r, m)
        want = want[~np.isnan(want)]
        assert acf[key, 0] == 1 and (acf[key, 1] is None) == (len(want) < 2)
        assert len(want) < 2 or np.allclose([acf[key, lag] for lag in range(6)], dg.acf(want, 5))
        if len(want) > 5:
            assert box[key] == pytest.approx(dg.ljung_box(want, 5)) == (kernel[key].lb_q, kernel[key].lb_p)
            assert even[key] == pytest.approx(dg.ljung_box(want, 4)[1])
        for got in (summary[key], kernel[key]):
            assert (got.log_likelihood, got.aic, got.resid_mean, got.resid_std) == pytest.approx((r.log_likelihood, 2 - 2 * r.log_likelihood, want.mean(), want.std()))
        assert kernel[key].n_missing == int(np.isnan(y).sum())


def test_estimation_rows(frame, truth):
    one = frame.where("key in ('a', 'c')")
    fn = lambda p: md.local_level(math.exp(min(p[0], 20)), math.exp(min(p[1], 20)))
    got = {r["key"]: r for r in ops.fit_mle_series(one, SPEC, fn, [0.0, 0.5], max_iter=50).collect()}
    for key in ("a", "c"):
        want = es.fit_mle(fn, truth[key], [0.0, 0.5], 50)
        assert got[key].log_likelihood == pytest.approx(want.log_likelihood) and md.StateSpaceModel.from_json(got[key].model).V[0, 0] == pytest.approx(want.model.V[0, 0])
    em = {r["key"]: r for r in ops.fit_em_series(one, SPEC, md.local_level(1, 2), 10).collect()}
    assert em["a"].history == pytest.approx(es.fit_em(truth["a"], md.local_level(1, 2), 10).log_likelihood_history)
    pooled = ops.fit_mle_pooled(one, SPEC, fn, [0.0, 0.5], max_iter=5)
    both = lambda p: -sum(k.kalman_filter(fn(p), truth[key]).log_likelihood for key in ("a", "c"))
    assert pooled.value == pytest.approx(both(pooled.x)) and pooled.value <= both(np.array([0.0, 0.5]))


def test_prepare(spark):
    df = spark.createDataFrame([("a", "2024-01-01", 1.0), ("a", "2024-01-04", 2.0), ("b", "2024-01-02", 3.0)], "key string, d string, y double").withColumn("ts", F.to_timestamp("d"))
    days = prepare.fill_gaps(prepare.resample(df, ["key"], "ts", "day", y=F.sum("y")), ["key"], "day").orderBy("key", "ts").collect()
    assert [(r["key"], r.ts.day, r.y) for r in days] == [("a", 1, 1.0), ("a", 2, None), ("a", 3, None), ("a", 4, 2.0), ("b", 2, 3.0)]
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "key string, ts int")
    right = spark.createDataFrame([("a", 1, 10), ("a", 4, 40), ("a", 6, 60)], "key string, ts int, v int")
    assert sorted((r["key"], r.ts, r.v) for r in prepare.as_of(left, right, ["key"], "ts", "v").collect()) == [("a", 1, 10), ("a", 5, 40), ("b", 9, None)]
    assert [r.t for r in prepare.number_rows(left, ["key"]).orderBy("key", "ts").collect()] == [1, 2, 1]
    nan = spark.createDataFrame([(math.nan,), (1.0,), (None,)], "y double")
    assert nan.select(prepare.observed(F.col("y")).alias("y")).where("y is null").count() == 2


def test_facade(spark):
    dlm = SparkDLM(md.local_level(38.0, 123.0))
    assert repr(dlm) == "SparkDLM(state_dim=1, obs_dim=1, not fitted)" and "(not fitted)" in dlm.summary()
    for call, text in ((lambda: dlm.filter_result, "not fitted"), (lambda: dlm.smoother_result, "not smoothed"), (dlm.smooth, "not fitted"), (dlm.forecast, "not fitted"), (dlm.forecast_smoothed, "not smoothed")):
        with pytest.raises(RuntimeError, match=text):
            call()
    nile = datasets.load_nile(spark)
    assert [(r.ts, r.nile_flow) for r in nile.orderBy("ts").collect()][::99] == [(datetime.date(1871, 12, 31), 1120.0), (datetime.date(1970, 12, 31), 740.0)]
    assert dlm.fit(nile, SeriesSpec((), "ts", "nile_flow"), freq="YE").smooth() is dlm
    with pytest.raises(RuntimeError, match="No forecast"):
        dlm.plot_data("forecast")
    ahead = dlm.forecast(3).orderBy("h").collect()
    assert [r.ts.year for r in ahead] == [1971, 1972, 1973] and ahead[0].lower_95 == pytest.approx(517.8832219769)
    assert dlm.forecast_smoothed(3).orderBy("h").collect() == ahead
    assert "Log-likelihood:  -640.9897" in dlm.summary() and repr(dlm).endswith(", fitted)")
    assert dlm.filtered_states_df().columns == ["ts", "t", "state_0"] and dlm.smoothed_states_df().count() == 100
    assert dlm.ljung_box().first().lb_q == pytest.approx(14.12286799756878)
    sizes = {kind: dlm.plot_data(kind).count() for kind in ("filtered", "smoothed", "forecast", "components")}
    assert sizes == {"filtered": 100, "smoothed": 100, "forecast": 109, "components": 100}
    assert dlm.plot_data("forecast", n_history=10_000).count() == 109 and dlm.plot_data("forecast", n_history=10).count() == 19
    panels = {r.panel: r["count"] for r in dlm.plot_data("panel").groupBy("panel").count().collect()}
    assert set(panels) == {"filtered", "smoothed", "forecast", "residuals", "histogram", "qq", "acf"} and panels["acf"] == 20
    hist = dlm.plot_data("diagnostics").where("panel = 'histogram'").collect()
    z = dg.standardized_residuals(k.kalman_filter(md.local_level(38.0, 123.0), datasets.values("nile")), md.local_level(38.0, 123.0))
    want, edges = np.histogram(z, 25, density=True)
    assert {round(r.x, 6): pytest.approx(r.y) for r in hist} == {round((a + b) / 2, 6): v for v, a, b in zip(want, edges[:-1], edges[1:], strict=True) if v}
    with pytest.raises(ValueError, match="Unknown plot kind"):
        dlm.plot_data("pie")
    dlm.fit(nile, SeriesSpec((), "ts", "nile_flow"))
    with pytest.raises(RuntimeError):
        dlm.smoother_result  # noqa: B018
    assert plot_data.normal_density([0.0])[0] == pytest.approx(0.39894228)


def test_seasonal_workflow(spark):
    y = np.log(datasets.values("airline"))
    model = md.local_linear_trend(0.02, 0.001, 0.02) + md.seasonal(12, 0.01)
    df = datasets.load_airline(spark).withColumn("y", F.log("passengers"))
    dlm = SparkDLM(model).fit(df, SeriesSpec((), "ts", "y"), freq="ME")
    got = [r["mean"] for r in dlm.forecast(24).orderBy("h").collect()]
    assert np.allclose(got, k.forecast_from_filter(model, k.kalman_filter(model, y), 24).mean[:, 0])
    assert datasets.load_lynx(spark).count() == 114 and datasets.load_temperature(spark).count() == 144


def test_datasets_from_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text("1\n2.5\n3\n")
    rows = datasets.load_gdp(spark, str(tmp_path / "s.csv")).orderBy("ts").collect()
    assert [(r.ts, r.gdp_growth) for r in rows] == [(datetime.date(1947, 6, 30), 1.0), (datetime.date(1947, 9, 30), 2.5), (datetime.date(1947, 12, 31), 3.0)]
    assert datasets.load_sunspots(spark, str(tmp_path / "s.csv")).count() == 3


def test_stream_is_the_batch_filter(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [("ab"[n % 2], n, float(rng.normal())) for n in range(60)]
    m = md.local_level(1, 2)
    schema = "key string, ts long, y double"
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20][::-1], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    late = spark.createDataFrame([("a", 2, 99.0)], schema)
    late.coalesce(1).write.parquet(f"{tmp_path}/in/3")
    out = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
    query = filter_stream(stream, "key", "ts", "y", m).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(lambda df, _: out.extend(df.collect())).start()
    query.awaitTermination()
    assert [r.late for r in out if r.y == 99.0] == [True]
    for key in "ab":
        want = k.kalman_scan(m, np.array([[[v] for kk, _, v in rows if kk == key]]))
        own = sorted((r.ts, r.mean, r.variance, r.cum_ll) for r in out if r["key"] == key and not r.late)
        assert np.allclose([v[1] for v in own], want.filt_mean[0, :, 0]) and np.allclose([v[3] for v in own], np.cumsum(want.ll[0]))


def test_null_keys_keep_their_values(spark):
    import datetime as dt

    from fjordline.operators import diagnose, prepare

    day = lambda k: dt.datetime(2020, 1, k)
    rows = [(None, day(1), 1.0), (None, day(4), 4.0), ("a", day(2), 2.0), ("a", day(3), 3.0)]
    df = spark.createDataFrame(rows, "g string, ts timestamp, y double")
    got = {(r.g, r.ts.day): r.y for r in prepare.fill_gaps(df, ["g"], "day").collect()}
    assert got == {(None, 1): 1.0, (None, 2): None, (None, 3): None, (None, 4): 4.0, ("a", 2): 2.0, ("a", 3): 3.0}
    bins = diagnose.histogram(df, ["g"], "y", 2).groupBy("g").sum("count").collect()
    assert {r[0]: r[1] for r in bins} == {None: 2, "a": 2}


def test_frequency_is_that_of_the_median_gap(spark):
    import datetime as dt

    from fjordline.operators.series import SeriesSpec, infer_freq
    from fjordline.sources import datasets

    assert infer_freq(datasets.load_nile(spark), SeriesSpec((), "ts", "nile_flow")) == "YE"
    assert infer_freq(datasets.load_airline(spark), SeriesSpec((), "ts", "y")) == "ME"
    for step, want in ((1, "D"), (7, "W"), (90, "QE"), (3, None)):
        df = spark.createDataFrame([("a", dt.date(2020, 1, 1) + dt.timedelta(step * k), 1.0) for k in range(5)], "g string, ts date, y double")
        assert infer_freq(df, SeriesSpec("g")) == want
    assert infer_freq(spark.createDataFrame([("a", 1, 1.0)], "g string, ts int, y double"), SeriesSpec("g")) is None
