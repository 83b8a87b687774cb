"""The data behind each plot, as DataFrames."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordline.functions.kernels import z_score
from fjordline.operators import diagnose, prepare
from fjordline.operators.series import SeriesSpec, with_bands
from fjordline.plans.model import StateSpaceModel


def _quadratic(model: StateSpaceModel, component: int, cov: str):
    f = model.F[component]
    n = model.state_dim
    terms = [F.lit(float(f[i] * f[j])) * F.col(cov)[i][j] for i in range(n) for j in range(n) if f[i] * f[j]]
    return reduce(lambda a, b: a + b, terms, F.lit(float(model.V[component, component])))


def fitted(rows: DataFrame, spec: SeriesSpec, model: StateSpaceModel, which: str = "filt", component: int = 0, level: float = 0.95) -> DataFrame:
    """keys, ts, t, observed, mean, lower, upper: F m with the band of F C F' + V, filtered ('filt') or smoothed ('smooth')."""
    f = model.F[component]
    mean = reduce(lambda a, b: a + b, [F.lit(float(f[i])) * F.col(f"{which}_mean")[i] for i in range(model.state_dim) if f[i]], F.lit(0.0))
    out = rows.select(*spec.keys, spec.ts, "t", F.col("y")[component].alias("observed"), mean.alias("mean"), _quadratic(model, component, f"{which}_cov").alias("variance"))
    return with_bands(out, "mean", "variance", level)


def components(smoothed: DataFrame, spec: SeriesSpec, component_dims: dict[str, int | slice] | None = None, level: float = 0.95, which: str = "smooth") -> DataFrame:
    """keys, ts, t, component, mean, lower, upper of named states (a slice names its first); the band is the state's own, without V."""
    dims = component_dims or {"state_0": 0}
    at = {k: (v.start or 0) if isinstance(v, slice) else v for k, v in dims.items()}
    each = F.array(*[F.struct(F.lit(k).alias("component"), F.col(f"{which}_mean")[i].alias("mean"), F.col(f"{which}_cov")[i][i].alias("variance")) for k, i in at.items()])
    return with_bands(smoothed.select(*spec.keys, spec.ts, "t", F.explode(each).alias("c")).select(*spec.keys, spec.ts, "t", "c.*"), "mean", "variance", level)


def forecast(filtered: DataFrame, ahead: DataFrame, spec: SeriesSpec, component: int = 0, levels: tuple[float, ...] = (0.5, 0.8, 0.95), n_history: int | None = None) -> DataFrame:
    """keys, x, level, kind, mean, lower, upper: history (at most all of it), then one row per step and level, widest band first.  x counts from 0."""
    from pyspark.sql import Window

    own = Window.partitionBy(*spec.keys)
    history = filtered.select(*spec.keys, F.col("t"), F.max("t").over(own).alias("n"), F.col("y")[component].alias("mean"))
    if n_history is not None:
        history = history.where(F.col("t") > F.col("n") - n_history)
    none = F.lit(None).cast("double")
    past = history.select(*spec.keys, (F.col("t") - 1).alias("x"), none.alias("level"), F.lit("history").alias("kind"), "mean", none.alias("lower"), none.alias("upper"))
    sizes = filtered.groupBy(*spec.keys).agg(F.max("t").alias("n"))
    rows = ahead.where(F.col("component") == component)
    rows = prepare.join_keys(rows, sizes, list(spec.keys)) if spec.keys else rows.crossJoin(F.broadcast(sizes))  # one row of sizes without keys
    bands = F.explode(F.array(*[F.struct(F.lit(float(v)).alias("level"), F.lit(z_score(v)).alias("z")) for v in sorted(levels, reverse=True)]))
    rows = rows.select("*", bands.alias("b"))
    half = F.col("b.z") * F.sqrt("variance")
    future = rows.select(*spec.keys, (F.col("n") + F.col("h") - 1).cast("long").alias("x"), F.col("b.level").alias("level"), F.lit("forecast").alias("kind"), "mean", (F.col("mean") - half).alias("lower"), (F.col("mean") + half).alias("upper"))
    return past.unionByName(future)


def diagnostics(filtered: DataFrame, spec: SeriesSpec, n_lags: int = 20, bins: int = 25) -> DataFrame:
    """keys, panel (residuals, histogram, qq, acf), x, y, bound: time and residual; bin middle and density; normal quantile and sample; lag and correlation with +-1.96 / sqrt(n)."""
    from statistics import NormalDist

    import pandas as pd

    keys = list(spec.keys)
    z = diagnose.residuals(filtered).where("resid is not null")
    none = F.lit(None).cast("double")
    quantile = F.pandas_udf(lambda p: pd.Series([NormalDist().inv_cdf(v) for v in p], dtype=float), "double")
    part = lambda name, rows, x, y, bound=none: rows.select(*keys, F.lit(name).alias("panel"), x.cast("double").alias("x"), y.alias("y"), bound.alias("bound"))
    parts = [
        part("residuals", z, F.col("t"), F.col("resid")),
        part("histogram", diagnose.histogram(z, keys, "resid", bins), (F.col("left") + F.col("right")) / 2, F.col("density")),
        part("qq", diagnose.qq_points(z, keys, "resid"), quantile(F.col("prob")), F.col("sample")),
        part("acf", diagnose.acf(z, keys, "t", "resid", n_lags).where("lag >= 1"), F.col("lag"), F.col("acf"), 1.96 / F.sqrt(F.col("n"))),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def panel(filtered: DataFrame, smoothed: DataFrame | None, ahead: DataFrame | None, spec: SeriesSpec, model: StateSpaceModel, component: int = 0, level: float = 0.95, forecast_levels: tuple[float, ...] = (0.5, 0.8, 0.95), n_history: int | None = None, n_lags: int = 20) -> DataFrame:
    """keys, panel, x, level, mean, lower, upper: filtered, smoothed and forecast bands (those there are) and the diagnostics."""
    none = F.lit(None).cast("double")
    band = lambda name, rows: rows.select(*spec.keys, F.lit(name).alias("panel"), F.col("t").cast("double").alias("x"), F.lit(level).alias("level"), "mean", "lower", "upper")
    parts = [band("filtered", fitted(filtered, spec, model, "filt", component, level))]
    if smoothed is not None:
        parts.append(band("smoothed", fitted(smoothed, spec, model, "smooth", component, level)))
    if ahead is not None:
        rows = forecast(filtered, ahead, spec, component, forecast_levels, n_history)
        parts.append(rows.select(*spec.keys, F.lit("forecast").alias("panel"), F.col("x").cast("double").alias("x"), "level", "mean", "lower", "upper"))
    rows = diagnostics(filtered, spec, n_lags)
    parts.append(rows.select(*spec.keys, "panel", "x", none.alias("level"), F.col("y").alias("mean"), (-F.col("bound")).alias("lower"), F.col("bound").alias("upper")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def normal_density(x: object) -> np.ndarray:
    """The curve over the residual histogram."""
    return np.exp(-0.5 * np.asarray(x, float) ** 2) / np.sqrt(2 * np.pi)
