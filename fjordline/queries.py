"""Registered queries over the driver's tables, one per operator, and the same results in DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordline.functions.kernels import z_score
from fjordline.functions.ship import ship
from fjordline.operators import diagnose, plot_data, prepare
from fjordline.operators.series import SeriesSpec, continue_dates, filter_series, fit_em_series, fit_mle_pooled, fit_mle_series, forecast_states, last_state, nonlinear_series, pacf_column, smooth_series, summary_series, with_bands
from fjordline.plans import fold
from fjordline.plans.facade import SparkDLM
from fjordline.plans.model import NonlinearSSM, StateSpaceModel, autoregressive, cycle, local_level, local_linear_trend, regression, seasonal
from fjordline.sources import datasets

LEVEL = local_level(20.0, 30.0)
TREND = local_linear_trend(20.0, 2.0, 30.0)
AR1 = autoregressive(1, [0.8], 20.0, 30.0)
CYCLE = cycle(12.0, 0.95, 20.0, 30.0)
QUARTER = seasonal(4, 20.0, 30.0)
CONSTANT = regression(1, 0.0, 30.0)
LEVEL_AR1 = local_level(10.0, 20.0) + autoregressive(1, [0.5], 15.0, 10.0)
CONTROLLED = StateSpaceModel([[1.0]], [[0.5]], [[900.0]], [[400.0]], [[2.0]])
USERS = local_level(1.0, 5.0)
WAVE = NonlinearSSM(lambda x: x + 0.1 * np.sin(x), lambda x: x, [[0.5]], [[1.0]], 1, 1)
PLANE = NonlinearSSM(lambda x: 0.99 * x, lambda x: x, np.eye(2) * 0.1, np.eye(2), 2, 2)
AIRLINE = local_linear_trend(20.0, 2.0, 30.0) + seasonal(12, 10.0, 0.0)
FOURIER = seasonal(6, 20.0, 30.0, "fourier")
TWICE = StateSpaceModel([[1.0], [1.0]], [[1.0]], [[900.0, 0.0], [0.0, 400.0]], [[400.0]])
BY_FLAG, BY_USER, BY_TYPE = SeriesSpec("g"), SeriesSpec("g"), SeriesSpec("g")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly quantities by return flag: g, ts, y."""
    items = _read(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "g")
    return prepare.resample(items, ["g"], "l_shipdate", "month", y=F.sum("l_quantity"))


def daily(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Daily mean values of events by a key, days without events missing: g, ts, y."""
    events = _read(spark, sf_dir, "events").withColumnRenamed(key, "g")
    return prepare.fill_gaps(prepare.resample(events, ["g"], "ts", "day", y=F.avg("value")), ["g"], "day")


def _gappy(df: DataFrame) -> DataFrame:
    """Every seventh month missing."""
    return df.withColumn("y", F.when(F.month("ts") % 7 != 0, F.col("y")))


def _round(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({k: F.round(F.col(k), d) for k, d in digits.items()})


def _final(df: DataFrame, model: StateSpaceModel, u: str | None = None) -> DataFrame:
    got = fold.final_state(df, ["g"], model, u=u)
    return got.select("g", "n", *[F.round(c, 4).alias(c) for c in got.columns if c not in ("g", "n")])


def series_resample_month(spark, sf_dir):
    return flags(spark, sf_dir)


def series_gap_fill(spark, sf_dir):
    return _round(daily(spark, sf_dir, "user_id"), y=6)


def series_as_of(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders")
    left = orders.select(F.col("o_custkey").alias("g"), F.date_trunc("month", "o_orderdate").alias("ts")).distinct()
    right = orders.groupBy(F.col("o_custkey").alias("g"), F.col("o_orderdate").alias("ts")).agg(F.max("o_totalprice").alias("price"))
    return prepare.as_of(left, right, ["g"], "ts", "price")


def local_level_final_state(spark, sf_dir):
    return _final(flags(spark, sf_dir), LEVEL)


def local_level_missing(spark, sf_dir):
    return _final(_gappy(flags(spark, sf_dir)), LEVEL)


def trend_filter(spark, sf_dir):
    return _final(flags(spark, sf_dir), TREND)


def ar1_filter(spark, sf_dir):
    return _final(flags(spark, sf_dir), AR1)


def cycle_filter(spark, sf_dir):
    return _final(flags(spark, sf_dir), CYCLE)


def seasonal_quarter_filter(spark, sf_dir):
    return _final(flags(spark, sf_dir), QUARTER)


def regression_static(spark, sf_dir):
    return _final(flags(spark, sf_dir), CONSTANT)


def superposition_level_ar1(spark, sf_dir):
    return _final(flags(spark, sf_dir), LEVEL_AR1)


def control_input_filter(spark, sf_dir):
    return _final(flags(spark, sf_dir).withColumn("u", F.month("ts").cast("double")), CONTROLLED, "u")


def control_input_kernel(spark, sf_dir):
    got = last_state(flags(spark, sf_dir).withColumn("u", F.month("ts").cast("double")), SeriesSpec("g", u="u"), CONTROLLED)
    return got.select("g", F.round(F.col("mean")[0], 4).alias("m0"), F.round(F.col("cov")[0][0], 4).alias("c00"), F.round("log_likelihood", 4).alias("ll"))


def local_level_filter_rows(spark, sf_dir):
    got = filter_series(flags(spark, sf_dir), BY_FLAG, LEVEL, outputs=("pred_mean", "pred_cov", "filt_mean", "filt_cov", "innov", "innov_cov", "ll"))
    return got.select("g", "ts", "t", *[F.round(c, 4).alias(n) for n, c in (("a0", F.col("pred_mean")[0]), ("r00", F.col("pred_cov")[0][0]), ("m0", F.col("filt_mean")[0]), ("c00", F.col("filt_cov")[0][0]), ("e", F.col("innov")[0]), ("q", F.col("innov_cov")[0][0]), ("ll", F.col("ll")))])


def running_loglik(spark, sf_dir):
    got = diagnose.running_likelihood(filter_series(flags(spark, sf_dir), BY_FLAG, LEVEL, outputs=("ll",)), ["g"])
    return got.select("g", "t", F.round("cum_ll", 4).alias("cum_ll"))


def local_level_fold_rows(spark, sf_dir):
    return _round(fold.level_rows(flags(spark, sf_dir), ["g"], LEVEL), a=4, r=4, m=4, c=4, ll=4)


def local_level_smooth(spark, sf_dir):
    return _round(fold.level_rows(flags(spark, sf_dir), ["g"], LEVEL, smooth=True).select("g", "t", "m", "c", "s", "p"), m=4, c=4, s=4, p=4)


def smooth_kernel(spark, sf_dir):
    got = smooth_series(flags(spark, sf_dir), BY_FLAG, LEVEL, outputs=("filt_mean", "filt_cov", "smooth_mean", "smooth_cov"))
    return got.select("g", "t", *[F.round(c, 4).alias(n) for n, c in (("m", F.col("filt_mean")[0]), ("c", F.col("filt_cov")[0][0]), ("s", F.col("smooth_mean")[0]), ("p", F.col("smooth_cov")[0][0]))])


def _states(df: DataFrame, model: StateSpaceModel) -> DataFrame:
    return last_state(df, BY_FLAG, model).select("g", "last_ts", "mean", "cov")


def forecast_level(spark, sf_dir):
    got = forecast_states(_states(flags(spark, sf_dir), LEVEL), LEVEL, 12)
    return got.select("g", "h", F.round(F.col("obs_mean")[0], 4).alias("mean"), F.round(F.col("obs_cov")[0][0], 4).alias("variance"))


def forecast_trend(spark, sf_dir):
    got = forecast_states(_states(flags(spark, sf_dir), TREND), TREND, 12)
    return got.select("g", "h", F.round(F.col("obs_mean")[0], 4).alias("mean"), F.round(F.col("obs_cov")[0][0], 4).alias("variance"))


def confidence_bands(spark, sf_dir):
    got = forecast_states(_states(flags(spark, sf_dir), LEVEL), LEVEL, 6).select("g", "h", F.col("obs_mean")[0].alias("mean"), F.col("obs_cov")[0][0].alias("variance"))
    for level in (50, 80, 95):
        got = with_bands(got, "mean", "variance", level / 100, f"lower_{level}", f"upper_{level}")
    return got.select("g", "h", *[F.round(c, 4).alias(c) for c in got.columns if "_" in c])


def forecast_dates(spark, sf_dir):
    last = flags(spark, sf_dir).groupBy("g").agg(F.max("ts").alias("last_ts"))
    rows = last.select("g", "last_ts", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("h"))
    return rows.select("g", "h", continue_dates(F.col("last_ts"), F.col("h"), "ME").alias("month_end"), continue_dates(F.col("last_ts"), F.col("h"), "QE").alias("quarter_end"), continue_dates(F.col("last_ts"), F.col("h"), "YE").alias("year_end"))


def _residuals(spark, sf_dir) -> DataFrame:
    return diagnose.residuals(filter_series(_gappy(flags(spark, sf_dir)), BY_FLAG, LEVEL, outputs=("innov", "innov_cov", "ll")))


def std_residuals(spark, sf_dir):
    return _residuals(spark, sf_dir).select("g", "t", F.round("resid", 6).alias("resid"))


def fit_summary(spark, sf_dir):
    filtered = filter_series(_gappy(flags(spark, sf_dir)), BY_FLAG, LEVEL, outputs=("innov", "innov_cov", "ll"))
    return _round(diagnose.fit_summary(filtered, ["g"], 1), log_likelihood=4, aic=4, resid_mean=6, resid_std=6)


def summary_kernel(spark, sf_dir):
    return _round(summary_series(flags(spark, sf_dir), BY_FLAG, LEVEL).select("g", "n_obs", "n_missing", "log_likelihood", "aic", "resid_mean", "resid_std"), log_likelihood=4, aic=4, resid_mean=6, resid_std=6)


def residual_acf(spark, sf_dir):
    return _round(diagnose.acf(flags(spark, sf_dir), ["g"], "ts", "y", 20), acf=6)


def ljung_box(spark, sf_dir):
    got = diagnose.ljung_box(diagnose.acf(flags(spark, sf_dir), ["g"], "ts", "y", 10), ["g"], 10)
    return _round(got, lb_q=4, lb_p=8)


def residual_pacf(spark, sf_dir):
    return _round(pacf_column(diagnose.acf(flags(spark, sf_dir), ["g"], "ts", "y", 20), ["g"]), pacf=6)


def qq_points(spark, sf_dir):
    return _round(diagnose.qq_points(flags(spark, sf_dir), ["g"], "y"), sample=6, prob=9)


def histogram(spark, sf_dir):
    return _round(diagnose.histogram(flags(spark, sf_dir), ["g"], "y"), density=9, left=6, right=6)


def batch_filter_by_user(spark, sf_dir):
    got = last_state(daily(spark, sf_dir, "user_id"), BY_USER, USERS)
    return got.select("g", "n_obs", F.round("log_likelihood", 4).alias("ll"), F.round(F.col("mean")[0], 6).alias("m0"), F.round(F.col("cov")[0][0], 6).alias("c00"))


def ekf_scalar(spark, sf_dir):
    got = nonlinear_series(daily(spark, sf_dir, "event_type"), BY_TYPE, WAVE, "ekf", outputs=("filt_mean", "filt_cov", "ll"))
    return got.select("g", "t", F.round(F.col("filt_mean")[0], 4).alias("m0"), F.round(F.col("filt_cov")[0][0], 4).alias("c00"), F.round("ll", 4).alias("ll"))


def ukf_scalar(spark, sf_dir):
    got = nonlinear_series(daily(spark, sf_dir, "event_type"), BY_TYPE, WAVE, "ukf", outputs=("filt_mean", "filt_cov", "ll"), alpha=1.0)
    return got.select("g", "t", F.round(F.col("filt_mean")[0], 4).alias("m0"), F.round(F.col("filt_cov")[0][0], 4).alias("c00"), F.round("ll", 4).alias("ll"))


def ukf_plane(spark, sf_dir):
    rows = daily(spark, sf_dir, "event_type").withColumn("y2", F.col("y") * 0.5)
    got = nonlinear_series(rows, SeriesSpec("g", y=("y", "y2")), PLANE, "ukf", outputs=("filt_mean", "ll"), alpha=1.0, sigma="columns")
    return got.select("g", "t", F.round(F.col("filt_mean")[0], 4).alias("m0"), F.round(F.col("filt_mean")[1], 4).alias("m1"), F.round("ll", 4).alias("ll"))


def airline_model_filter(spark, sf_dir):
    """Trend and twelve seasons: 13 states."""
    got = filter_series(flags(spark, sf_dir), BY_FLAG, AIRLINE, outputs=("filt_mean", "ll"))
    return got.select("g", "t", F.round(F.col("filt_mean")[0], 2).alias("level"), F.round(F.col("filt_mean")[0] + F.col("filt_mean")[2], 2).alias("signal"), F.round("ll", 3).alias("ll"))


def fourier_filter(spark, sf_dir):
    got = filter_series(flags(spark, sf_dir), BY_FLAG, FOURIER, outputs=("filt_mean", "ll"))
    mean = F.col("filt_mean")
    return got.select("g", "t", F.round(mean[0] + mean[2] + mean[4], 3).alias("signal"), F.round(mean[1], 3).alias("other"), F.round("ll", 3).alias("ll"))


def bivariate_filter(spark, sf_dir):
    rows = flags(spark, sf_dir).withColumn("y2", F.col("y") + 10 * F.month("ts"))
    got = filter_series(rows, SeriesSpec("g", y=("y", "y2")), TWICE, outputs=("filt_mean", "filt_cov", "ll"))
    return got.select("g", "t", F.round(F.col("filt_mean")[0], 4).alias("m0"), F.round(F.col("filt_cov")[0][0], 4).alias("c00"), F.round("ll", 4).alias("ll"))


def em_step_once(spark, sf_dir):
    got = fit_em_series(flags(spark, sf_dir), BY_FLAG, LEVEL, 1, 0.0, "approx")
    model = F.from_json("model", "F array<array<double>>, V array<array<double>>, W array<array<double>>")
    return got.select("g", F.round(model["V"][0][0], 4).alias("v"), F.round(model["W"][0][0], 4).alias("w"))


def _scale(p):
    return local_level(math.exp(min(p[0], 40.0)), math.exp(min(p[1], 40.0)))


def mle_by_flag(spark, sf_dir):
    return fit_mle_series(flags(spark, sf_dir), BY_FLAG, _scale, [3.0, 5.0], max_iter=60).select("g", F.round("log_likelihood", 2).alias("ll"), "converged")


def mle_pooled(spark, sf_dir):
    best = fit_mle_pooled(flags(spark, sf_dir), BY_FLAG, _scale, [4.0, 5.0], max_iter=8)
    return spark.createDataFrame([(round(-best.value, 2), best.n_iterations)], "ll double, n_iterations int")


def em_by_flag(spark, sf_dir):
    return fit_em_series(flags(spark, sf_dir), BY_FLAG, LEVEL, 20, 1e-4, "exact").select("g", F.round("log_likelihood", 3).alias("ll"), "n_iterations")


def nile_forecast(spark, sf_dir):
    dlm = SparkDLM(local_level(38.0, 123.0)).fit(datasets.load_nile(spark), SeriesSpec((), "ts", "nile_flow"), freq="YE")
    return _round(dlm.forecast(10).select("h", "ts", "mean", "lower_95", "upper_95"), mean=6, lower_95=6, upper_95=6)


def plot_panel(spark, sf_dir):
    dlm = SparkDLM(LEVEL).fit(flags(spark, sf_dir), BY_FLAG, freq="ME").smooth()
    dlm.forecast(6)
    return dlm.plot_data("panel")


def plot_components(spark, sf_dir):
    rows = smooth_series(flags(spark, sf_dir), BY_FLAG, TREND)
    return plot_data.components(rows, BY_FLAG, {"level": 0, "slope": 1})


# DuckDB twins.

_FLAGS = "SELECT l_returnflag g, date_trunc('month', l_shipdate) ts, sum(l_quantity) y FROM lineitem GROUP BY 1, 2"
_GAPPY = f"SELECT g, ts, CASE WHEN month(ts) % 7 <> 0 THEN y END y FROM ({_FLAGS})"


def _days(key: str) -> str:
    return f"""SELECT c.g, c.ts, d.y FROM (SELECT g, unnest(generate_series(a, b, INTERVAL 1 DAY)) ts FROM
        (SELECT {key} g, min(date_trunc('day', ts)) a, max(date_trunc('day', ts)) b FROM events GROUP BY 1)) c
        LEFT JOIN (SELECT {key} g, date_trunc('day', ts) ts, avg(value) y FROM events GROUP BY 1, 2) d ON c.g = d.g AND c.ts = d.ts"""


def _filter_sql(source: str, model: StateSpaceModel, u: str = "0") -> str:
    """WITH RECURSIVE o (numbered series) and kf: per row the predicted a, r, the error e with variance q, the filtered m, c, and ll up to it."""
    n = range(model.state_dim)
    up = [(i, j) for i in n for j in n if i <= j]
    c = lambda i, j: f"kf.c{min(i, j)}{max(i, j)}"
    lit = lambda v: f"({float(v)!r})::DOUBLE"
    add = lambda terms: " + ".join(terms) if terms else "0::DOUBLE"
    g, f, w = model.G, model.F[0], model.W
    control = f" + {lit(model.B[0, 0])} * ({u})" if model.B is not None else ""
    ahead = ", ".join(f"{add([f'{lit(g[i, k])} * kf.m{k}' for k in n if g[i, k]])}{control} a{i}" for i in n)
    spread = ", ".join(f"{add([f'{lit(g[i, k] * g[j, q])} * {c(k, q)}' for k in n for q in n if g[i, k] * g[j, q]])} + {lit(w[i, j])} r{i}{j}" for i, j in up)
    r = lambda i, j: f"r{min(i, j)}{max(i, j)}"
    cross = ", ".join(f"{add([f'{lit(f[k])} * {r(i, k)}' for k in n if f[k]])} x{i}" for i in n)
    var = f"{add([f'{lit(f[i])} * x{i}' for i in n if f[i]])} + {lit(model.V[0, 0])} q"
    error = f"y - ({add([f'{lit(f[i])} * a{i}' for i in n if f[i]])}) e"
    names = ", ".join([f"m{i}" for i in n] + [f"c{i}{j}" for i, j in up])
    first = ", ".join([f"0::DOUBLE m{i}" for i in n] + [f"{1e6 if i == j else 0}::DOUBLE c{i}{j}" for i, j in up])
    none = ", ".join([f"NULL::DOUBLE a{i}" for i in n] + [f"NULL::DOUBLE r{i}{j}" for i, j in up] + ["NULL::DOUBLE q", "NULL::DOUBLE e", "NULL::DOUBLE y", "NULL::TIMESTAMP ts"])
    keep = ", ".join([f"a{i}" for i in n] + [f"r{i}{j}" for i, j in up] + ["q", "e", "y", "ts"])
    moved = ", ".join([f"CASE WHEN y IS NULL THEN a{i} ELSE a{i} + x{i} / q * e END m{i}" for i in n] + [f"CASE WHEN y IS NULL THEN r{i}{j} ELSE r{i}{j} - x{i} * x{j} / q END c{i}{j}" for i, j in up])
    return f"""WITH RECURSIVE src AS ({source}), o AS (SELECT g, ts, y::DOUBLE y, row_number() OVER (PARTITION BY g ORDER BY ts) t FROM src),
    kf AS (SELECT DISTINCT g, 0::BIGINT t, {first}, 0::DOUBLE ll, {none} FROM o
      UNION ALL
      SELECT g, t, {moved}, ll + CASE WHEN y IS NULL THEN 0 ELSE -0.5 * (ln(2 * pi()) + ln(q) + e * e / q) END ll, {keep} FROM
        (SELECT *, {var}, {error} FROM (SELECT *, {cross} FROM
          (SELECT kf.g, o.t, o.ts, o.y, kf.ll, {ahead}, {spread} FROM kf JOIN o ON o.g = kf.g AND o.t = kf.t + 1))))
    """ + f"/* {names} */"


def _final_sql(source: str, model: StateSpaceModel, u: str = "0") -> str:
    n = range(model.state_dim)
    names = [f"m{i}" for i in n] + [f"c{i}{j}" for i in n for j in n if i <= j] + ["ll"]
    cols = ", ".join(f"round({c}, 4) {c}" for c in names)
    return f"{_filter_sql(source, model, u)} SELECT g, t n, {cols} FROM kf WHERE t > 0 QUALIFY row_number() OVER (PARTITION BY g ORDER BY t DESC) = 1"


_SMOOTH = f"""{_filter_sql(_FLAGS, LEVEL)},
    p AS (SELECT k.g, k.t, k.y, k.m0 m, k.c00 c, n.a0 an, n.r00 rn FROM kf k LEFT JOIN kf n ON n.g = k.g AND n.t = k.t + 1 WHERE k.t > 0),
    s AS (SELECT g, t, y, m, c, m s, c p FROM p WHERE an IS NULL UNION ALL
          SELECT p.g, p.t, p.y, p.m, p.c, p.m + p.c / p.rn * (s.s - p.an), p.c + p.c / p.rn * (s.p - p.rn) * (p.c / p.rn) FROM s JOIN p ON p.g = s.g AND p.t = s.t - 1)"""

_ROWS = _filter_sql(_FLAGS, LEVEL)
_STEP_LL = "round(-0.5 * (ln(2 * pi()) + ln(q) + e * e / q), 4)"
_GAPPY_ROWS = _filter_sql(_GAPPY, LEVEL)
_ACF = """, src AS (SELECT g, ts, y - avg(y) OVER (PARTITION BY g) c FROM flags), o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY ts) t FROM src),
    k AS (SELECT unnest(range(0, 21))::INTEGER lag), v AS (SELECT g, count(*) n, sum(c * c) v FROM o GROUP BY 1),
    r AS (SELECT v.g, k.lag, v.n, CASE WHEN k.lag = 0 THEN 1.0::DOUBLE ELSE coalesce((SELECT sum(a.c * b.c) FROM o a JOIN o b ON a.g = b.g AND a.t = b.t + k.lag WHERE a.g = v.g), 0) / v.v END acf FROM v, k)"""


def _forecast_sql(model: StateSpaceModel, mean: str, variance: str, select: str, steps: int = 12) -> str:
    last = f"{_filter_sql(_FLAGS, model)}, z AS (SELECT * FROM kf WHERE t > 0 QUALIFY row_number() OVER (PARTITION BY g ORDER BY t DESC) = 1)"
    return f"{last}, fc AS (SELECT g, h::INTEGER h, {mean} mean, {variance} variance FROM z, (SELECT unnest(range(1, {steps + 1})) h)) SELECT {select} FROM fc"


_LEVEL_FC = ("m0", "c00 + h * 400.0 + 900.0")
#: After h steps of a trend: the level has gathered h W0 + W1 (0 + 1 + 4 + .. + (h - 1)^2).
_TREND_FC = ("m0 + h * m1", "c00 + 2 * h * c01 + h * h * c11 + h * 400.0 + 4.0 * ((h - 1) * h * (2 * h - 1) / 6.0) + 900.0")

_NONLINEAR_HEAD = f"""WITH RECURSIVE src AS ({_days("event_type")}), o AS (SELECT g, y, row_number() OVER (PARTITION BY g ORDER BY ts) t FROM src)"""
_EKF = f"""{_NONLINEAR_HEAD}, kf AS (SELECT DISTINCT g, 0::BIGINT t, 0::DOUBLE m, 1e6::DOUBLE c, 0::DOUBLE ll FROM o UNION ALL
    SELECT g, t, CASE WHEN y IS NULL THEN a ELSE a + r / (r + 1) * (y - a) END, CASE WHEN y IS NULL THEN r ELSE r - r * r / (r + 1) END,
           CASE WHEN y IS NULL THEN 0 ELSE -0.5 * (ln(2 * pi()) + ln(r + 1) + (y - a) ^ 2 / (r + 1)) END
    FROM (SELECT kf.g, o.t, o.y, kf.m + 0.1 * sin(kf.m) a, (1 + 0.1 * cos(kf.m)) ^ 2 * kf.c + 0.5 r FROM kf JOIN o ON o.g = kf.g AND o.t = kf.t + 1))
    SELECT g, t, round(m, 4) m0, round(c, 4) c00, round(ll, 4) ll FROM kf WHERE t > 0"""
#: With alpha = 1 and one state the three points weigh 0, 1/2, 1/2 in means and 2, 1/2, 1/2 in variances.
_UKF = f"""{_NONLINEAR_HEAD}, kf AS (SELECT DISTINCT g, 0::BIGINT t, 0::DOUBLE m, 1e6::DOUBLE c, 0::DOUBLE ll FROM o UNION ALL
    SELECT g, t, CASE WHEN y IS NULL THEN a ELSE a + r / (r + 1) * (y - a) END, CASE WHEN y IS NULL THEN r ELSE r - r * r / (r + 1) END,
           CASE WHEN y IS NULL THEN 0 ELSE -0.5 * (ln(2 * pi()) + ln(r + 1) + (y - a) ^ 2 / (r + 1)) END
    FROM (SELECT g, t, y, a, 2 * (f0 - a) ^ 2 + 0.5 * (f1 - a) ^ 2 + 0.5 * (f2 - a) ^ 2 + 0.5 r FROM (SELECT *, 0.5 * f1 + 0.5 * f2 a FROM
      (SELECT kf.g, o.t, o.y, kf.m + 0.1 * sin(kf.m) f0, kf.m + sqrt(kf.c) + 0.1 * sin(kf.m + sqrt(kf.c)) f1, kf.m - sqrt(kf.c) + 0.1 * sin(kf.m - sqrt(kf.c)) f2 FROM kf JOIN o ON o.g = kf.g AND o.t = kf.t + 1))))
    SELECT g, t, round(m, 4) m0, round(c, 4) c00, round(ll, 4) ll FROM kf WHERE t > 0"""

_BANDS = ", ".join(f"round(mean {sign} {z_score(v / 100)!r} * sqrt(variance), 4) {side}_{v}" for v in (50, 80, 95) for sign, side in (("-", "lower"), ("+", "upper")))
_CHI = " + ".join(f"(lb_q / 2) ^ {i} / {math.factorial(i)}.0" for i in range(5))

_STEP_LL3 = "round(-0.5 * (ln(2 * pi()) + ln(q) + e * e / q), 3)"
_BIVARIATE = f"""WITH RECURSIVE src AS (SELECT *, y + 10 * month(ts) y2 FROM ({_FLAGS})), o AS (SELECT g, y, y2, row_number() OVER (PARTITION BY g ORDER BY ts) t FROM src),
    kf AS (SELECT DISTINCT g, 0::BIGINT t, 0::DOUBLE m, 1e6::DOUBLE c, 0::DOUBLE ll FROM o UNION ALL
      SELECT g, t, m1 + c1 / (c1 + 400) * (y2 - m1), c1 - c1 * c1 / (c1 + 400), ll - 0.5 * (ln(2 * pi()) + ln(c1 + 400) + (y2 - m1) ^ 2 / (c1 + 400)) FROM
        (SELECT g, t, y2, m + r / (r + 900) * (y - m) m1, r - r * r / (r + 900) c1, -0.5 * (ln(2 * pi()) + ln(r + 900) + (y - m) ^ 2 / (r + 900)) ll FROM
          (SELECT kf.g, o.t, o.y, o.y2, kf.m, kf.c + 400 r FROM kf JOIN o ON o.g = kf.g AND o.t = kf.t + 1)))
    SELECT g, t, round(m, 4) m0, round(c, 4) c00, round(ll, 4) ll FROM kf WHERE t > 0"""
#: A linear model of two states that don't touch: what the unscented filter must give is two plain filters.
_SHRINK = StateSpaceModel([[1.0]], [[0.99]], [[1.0]], [[0.1]])
_SHRINK_LL = "CASE WHEN y IS NULL THEN 0 ELSE -0.5 * (ln(2 * pi()) + ln(q) + e * e / q) END"
_PLANE = f"""SELECT a.g, a.t, round(a.m, 4) m0, round(b.m, 4) m1, round(a.l + b.l, 4) ll FROM
    ({_filter_sql(_days("event_type"), _SHRINK)} SELECT g, t, m0 m, {_SHRINK_LL} l FROM kf WHERE t > 0) a JOIN
    ({_filter_sql(f'SELECT g, ts, y * 0.5 y FROM ({_days("event_type")})', _SHRINK)} SELECT g, t, m0 m, {_SHRINK_LL} l FROM kf WHERE t > 0) b ON a.g = b.g AND a.t = b.t"""
_PACF = f"""WITH RECURSIVE flags AS ({_FLAGS}){_ACF}, l AS (SELECT g, list(acf ORDER BY lag) FILTER (lag > 0) r FROM r GROUP BY g),
    d AS (SELECT g, 1 k, [r[1]] phi, r FROM l UNION ALL
      SELECT g, k + 1, list_concat(list_transform(range(1, k + 1), lambda j: phi[j] - a * phi[k + 1 - j]), [a]), r FROM
        (SELECT *, (r[k + 1] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 1 - j]))) / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j]))) a FROM d WHERE k < 20))
    SELECT g, k::INTEGER lag, round(phi[k], 6) pacf FROM d UNION ALL SELECT DISTINCT g, 0::INTEGER, 1.0::DOUBLE FROM l"""
_NILE_MODEL = local_level(38.0, 123.0)
_NILE_ROWS = " UNION ALL ".join(f"SELECT 'nile' g, make_date({1871 + k}, 1, 1)::TIMESTAMP ts, {v}.0::DOUBLE y" for k, v in enumerate(datasets.NILE))
_NILE = f"""{_filter_sql(_NILE_ROWS, _NILE_MODEL)}, z AS (SELECT m0, c00 FROM kf WHERE t = 100), f AS (SELECT h::INTEGER h, m0 mean, sqrt(c00 + h * {38.0**2} + {123.0**2}) sd FROM z, (SELECT unnest(range(1, 11)) h))
    SELECT h, make_date((1970 + h)::INTEGER, 12, 31) ts, round(mean, 6) mean, round(mean - {z_score(0.95)!r} * sd, 6) lower_95, round(mean + {z_score(0.95)!r} * sd, 6) upper_95 FROM f"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "series_resample_month": (series_resample_month, _FLAGS),
    "series_gap_fill": (series_gap_fill, f"SELECT g, ts, round(y, 6) y FROM ({_days('user_id')})"),
    "series_as_of": (series_as_of, """WITH l AS (SELECT DISTINCT o_custkey g, date_trunc('month', o_orderdate) ts FROM orders), r AS (SELECT o_custkey g, o_orderdate ts, max(o_totalprice) price FROM orders GROUP BY 1, 2)
        SELECT l.g, l.ts, r.price FROM l ASOF LEFT JOIN r ON l.g = r.g AND l.ts >= r.ts"""),
    "local_level_final_state": (local_level_final_state, _final_sql(_FLAGS, LEVEL)),
    "local_level_missing": (local_level_missing, _final_sql(_GAPPY, LEVEL)),
    "trend_filter": (trend_filter, _final_sql(_FLAGS, TREND)),
    "ar1_filter": (ar1_filter, _final_sql(_FLAGS, AR1)),
    "cycle_filter": (cycle_filter, _final_sql(_FLAGS, CYCLE)),
    "seasonal_quarter_filter": (seasonal_quarter_filter, _final_sql(_FLAGS, QUARTER)),
    "airline_model_filter": (airline_model_filter, f"{_filter_sql(_FLAGS, AIRLINE)} SELECT g, t, round(m0, 2) AS level, round(m0 + m2, 2) signal, {_STEP_LL3} ll FROM kf WHERE t > 0"),
    "fourier_filter": (fourier_filter, f"{_filter_sql(_FLAGS, FOURIER)} SELECT g, t, round(m0 + m2 + m4, 3) signal, round(m1, 3) other, {_STEP_LL3} ll FROM kf WHERE t > 0"),
    "bivariate_filter": (bivariate_filter, _BIVARIATE),
    "regression_static": (regression_static, _final_sql(_FLAGS, CONSTANT)),
    "superposition_level_ar1": (superposition_level_ar1, _final_sql(_FLAGS, LEVEL_AR1)),
    "control_input_filter": (control_input_filter, _final_sql(_FLAGS, CONTROLLED, "month(o.ts)")),
    "control_input_kernel": (control_input_kernel, f"SELECT g, m0, c00, ll FROM ({_final_sql(_FLAGS, CONTROLLED, 'month(o.ts)')})"),
    "local_level_filter_rows": (local_level_filter_rows, f"{_ROWS} SELECT g, ts, t, round(a0, 4) a0, round(r00, 4) r00, round(m0, 4) m0, round(c00, 4) c00, round(e, 4) e, round(q, 4) q, {_STEP_LL} ll FROM kf WHERE t > 0"),
    "local_level_fold_rows": (local_level_fold_rows, f"{_ROWS} SELECT g, t, ts, y, round(a0, 4) a, round(r00, 4) r, round(m0, 4) m, round(c00, 4) c, {_STEP_LL} ll FROM kf WHERE t > 0"),
    "running_loglik": (running_loglik, f"{_ROWS} SELECT g, t, round(ll, 4) cum_ll FROM kf WHERE t > 0"),
    "local_level_smooth": (local_level_smooth, f"{_SMOOTH} SELECT g, t, round(m, 4) m, round(c, 4) c, round(s, 4) s, round(p, 4) p FROM s"),
    "smooth_kernel": (smooth_kernel, f"{_SMOOTH} SELECT g, t, round(m, 4) m, round(c, 4) c, round(s, 4) s, round(p, 4) p FROM s"),
    "forecast_level": (forecast_level, _forecast_sql(LEVEL, *_LEVEL_FC, "g, h, round(mean, 4) mean, round(variance, 4) variance")),
    "forecast_trend": (forecast_trend, _forecast_sql(TREND, *_TREND_FC, "g, h, round(mean, 4) mean, round(variance, 4) variance")),
    "confidence_bands": (confidence_bands, _forecast_sql(LEVEL, *_LEVEL_FC, f"g, h, {_BANDS}", 6)),
    "forecast_dates": (forecast_dates, f"""SELECT g, h::INTEGER h, last_day(z + to_months(h::INTEGER)) month_end, last_day(z + to_months((3 * h)::INTEGER)) quarter_end, last_day(z + to_months((12 * h)::INTEGER)) year_end
        FROM (SELECT g, max(ts) z FROM ({_FLAGS}) GROUP BY 1), (SELECT unnest(range(1, 13)) h)"""),
    "std_residuals": (std_residuals, f"{_GAPPY_ROWS} SELECT g, t, round(e / sqrt(q), 6) resid FROM kf WHERE t > 0"),
    "fit_summary": (fit_summary, f"""{_GAPPY_ROWS} SELECT g, count(*) n_obs, round(max_by(ll, t), 4) log_likelihood, round(avg(e / sqrt(q)), 6) resid_mean, round(stddev_pop(e / sqrt(q)), 6) resid_std, round(-2 * max_by(ll, t) + 2, 4) aic
        FROM kf WHERE t > 0 GROUP BY g"""),
    "summary_kernel": (summary_kernel, f"""{_ROWS} SELECT g, count(*) n_obs, 0::BIGINT n_missing, round(max_by(ll, t), 4) log_likelihood, round(-2 * max_by(ll, t) + 2, 4) aic, round(avg(e / sqrt(q)), 6) resid_mean, round(stddev_pop(e / sqrt(q)), 6) resid_std
        FROM kf WHERE t > 0 GROUP BY g"""),
    "residual_acf": (residual_acf, f"WITH flags AS ({_FLAGS}){_ACF} SELECT g, lag, round(acf, 6) acf, n FROM r"),
    "ljung_box": (ljung_box, f"WITH flags AS ({_FLAGS}){_ACF}, l AS (SELECT g, n * (n + 2) * sum(acf * acf / (n - lag)) lb_q FROM r WHERE lag BETWEEN 1 AND 10 GROUP BY g, n) SELECT g, round(lb_q, 4) lb_q, round(exp(-lb_q / 2) * ({_CHI}), 8) lb_p FROM l"),
    "residual_pacf": (residual_pacf, _PACF),
    "qq_points": (qq_points, f"SELECT g, i, n, round(y, 6) sample, round((i - 0.5) / n, 9)::DOUBLE prob FROM (SELECT g, y, row_number() OVER (PARTITION BY g ORDER BY y) i, count(*) OVER (PARTITION BY g) n FROM ({_FLAGS}))"),
    "histogram": (histogram, f"""SELECT g, bin, count(*) count, round(count(*) / (any_value(n) * any_value(w)), 9) density, round(any_value(a) + bin * any_value(w), 6) "left", round(any_value(a) + (bin + 1) * any_value(w), 6) "right" FROM
        (SELECT g, a, n, w, least(24, floor((y - a) / w))::BIGINT bin FROM (SELECT *, (b - a) / 25 w FROM (SELECT g, y, min(y) OVER (PARTITION BY g) a, max(y) OVER (PARTITION BY g) b, count(*) OVER (PARTITION BY g) n FROM ({_FLAGS})))) GROUP BY g, bin"""),
    "batch_filter_by_user": (batch_filter_by_user, f"{_filter_sql(_days('user_id'), USERS)} SELECT g, t n_obs, round(ll, 4) ll, round(m0, 6) m0, round(c00, 6) c00 FROM kf WHERE t > 0 QUALIFY row_number() OVER (PARTITION BY g ORDER BY t DESC) = 1"),
    "ekf_scalar": (ekf_scalar, _EKF),
    "ukf_scalar": (ukf_scalar, _UKF),
    "ukf_plane": (ukf_plane, _PLANE),
    "em_step_once": (em_step_once, f"{_SMOOTH}, d AS (SELECT g, (y - s) ^ 2 + p v, (s - lag(s) OVER z) ^ 2 + p + lag(p) OVER z w FROM s WINDOW z AS (PARTITION BY g ORDER BY t)) SELECT g, round(avg(v), 4) v, round(avg(w), 4) w FROM d GROUP BY g"),
    "mle_by_flag": (mle_by_flag, None),
    "mle_pooled": (mle_pooled, None),
    "em_by_flag": (em_by_flag, None),
    "nile_forecast": (nile_forecast, _NILE),
    "plot_panel": (plot_panel, None),
    "plot_components": (plot_components, None),
}


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package sent to the workers first if they need it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
