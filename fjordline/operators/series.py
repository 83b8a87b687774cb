"""DataFrame operators over keyed, ordered series: filter, smooth, forecast, fit.

Series are rows (keys, ts, y).  One exchange by key, one sort, and the rows stream through Arrow to batched
NumPy kernels: consecutive whole series are gathered up to a bounded number of rows, and series of equal
length are filtered as one stack.  Null and NaN observations are both missing.  Within a key, ts must be
unique: the recursion is ordered (fjordline.operators.prepare makes it so).  Filters on keys and column
choices belong before these operators, as no optimizer pushes them through a kernel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fjordline.functions import kernels
from fjordline.functions.diagnostics import chi2_sf, ljung_box, pacf_from_acf
from fjordline.functions.estimation import fit_em, fit_mle, lbfgs
from fjordline.plans.model import GaussianState, NonlinearSSM, StateSpaceModel

#: Rows of whole series that go to a kernel at once (one longer series goes alone).
STACK_ROWS = 65_536

VECTOR, MATRIX = T.ArrayType(T.DoubleType()), T.ArrayType(T.ArrayType(T.DoubleType()))
#: What a filter can emit for each row.
OUTPUTS = {"pred_mean": VECTOR, "pred_cov": MATRIX, "filt_mean": VECTOR, "filt_cov": MATRIX, "innov": VECTOR, "innov_cov": MATRIX, "ll": T.DoubleType()}
SMOOTHED = {"smooth_mean": VECTOR, "smooth_cov": MATRIX}


@dataclass(frozen=True)
class SeriesSpec:
    """Names of columns: keys, the order, the observed values (one column of doubles or arrays, or several of doubles), and optionally
    control inputs u and a design vector x (columns of doubles)."""

    keys: tuple[str, ...]
    ts: str = "ts"
    y: tuple[str, ...] = ("y",)
    u: tuple[str, ...] = ()
    x: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for name in ("keys", "y", "u", "x"):
            value = getattr(self, name)
            object.__setattr__(self, name, (value,) if isinstance(value, str) else tuple(value))


def _numbers(df: DataFrame, names: tuple[str, ...], to: str):
    """One array column of doubles, NaN for null."""
    if len(names) == 1 and isinstance(df.schema[names[0]].dataType, T.ArrayType):
        return F.transform(F.col(names[0]), lambda v: F.coalesce(v.cast("double"), F.lit(float("nan")))).alias(to)
    return F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(float("nan"))) for n in names]).alias(to)


class Series:
    """One whole series in a task."""

    __slots__ = ("keys", "ts", "u", "x", "y")

    def __init__(self, keys: tuple, ts: pa.Array, y: np.ndarray, u: np.ndarray | None, x: np.ndarray | None) -> None:
        self.keys, self.ts, self.y, self.u, self.x = keys, ts, y, u, x


def _matrix(column: pa.Array) -> np.ndarray:
    width = len(column[0].as_py()) if len(column) else 0
    return np.asarray(column.flatten(), float).reshape(len(column), width)


def _stream(batches: Iterator[pa.RecordBatch], keys: int, most: int) -> Iterator[list[Series]]:
    """Whole series in order of key, gathered to about `most` rows; the last series of a batch waits for the next batch."""

    def cut(table: pa.Table, last: bool) -> tuple[list[Series], pa.Table | None]:
        table = table.combine_chunks()
        if not table.num_rows:
            return [], None
        change = np.zeros(table.num_rows - 1, bool)
        for k in range(keys + 1):
            c = table.column(k).to_pandas()
            a, b = c.iloc[:-1].reset_index(drop=True), c.iloc[1:].reset_index(drop=True)
            change |= ~((a == b) | (a.isna() & b.isna())).to_numpy(bool)
        at = [0, *(np.flatnonzero(change) + 1).tolist(), table.num_rows]
        whole = len(at) - 1 if last else len(at) - 2
        names = table.column_names
        mats = {n: _matrix(table.column(n).combine_chunks() if table.num_rows else None) for n in ("_y", "_u", "_x") if n in names}
        out = [Series(tuple(table.column(1 + k)[a].as_py() for k in range(keys)), table.column("_ts").slice(a, b - a), mats["_y"][a:b], mats["_u"][a:b] if "_u" in mats else None, mats["_x"][a:b] if "_x" in mats else None) for a, b in zip(at[:whole], at[1 : whole + 1], strict=True)]
        return out, None if last else table.slice(at[whole])

    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows >= most:
            out, rest = cut(pa.concat_tables(held), False)
            held, rows = ([rest], rest.num_rows) if rest is not None else ([], 0)
            if out:
                yield out
    if held:
        out, _ = cut(pa.concat_tables(held), True)
        if out:
            yield out


def _ordered(df: DataFrame, spec: SeriesSpec, partitions: int | None) -> DataFrame:
    """One exchange by key and one sort; only the columns that the kernels need."""
    cols = [F.xxhash64(*spec.keys).alias("_g") if spec.keys else F.lit(0).cast("long").alias("_g"), *spec.keys, F.col(spec.ts).alias("_ts"), _numbers(df, spec.y, "_y")]
    cols += [_numbers(df, spec.u, "_u")] if spec.u else []
    cols += [_numbers(df, spec.x, "_x")] if spec.x else []
    narrow = df.select(*cols)
    dealt = narrow.repartition(partitions, "_g") if partitions else narrow.repartition("_g")
    return dealt.sortWithinPartitions("_g", *spec.keys, "_ts")


def _nested(values: np.ndarray, rank: int) -> pa.Array:
    """(rows,), (rows, n) or (rows, n, n) as doubles, arrays or arrays of arrays."""
    if rank == 0:
        return pa.array(values.reshape(-1))
    out = pa.array(np.ascontiguousarray(values).reshape(-1))
    for width in values.shape[:0:-1]:
        out = pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) + 1, width, dtype=np.int32)), out) if width else out
    return out


def _emit(spec: SeriesSpec, schema: T.StructType, run: Callable[[list[Series]], list[dict[str, np.ndarray]]], most: int):
    """Kernel results (by series: column -> array by time) as rows of keys, ts, t, y and the columns."""
    n_keys, names = len(spec.keys), [f.name for f in schema.fields]
    kinds = {f.name: f.dataType for f in schema.fields}
    rank = lambda kind: 0 if not isinstance(kind, T.ArrayType) else 1 if not isinstance(kind.elementType, T.ArrayType) else 2
    arrow = {f.name: _arrow(f.dataType) for f in schema.fields}

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stack in _stream(batches, n_keys, most):
            for series, got in zip(stack, run(stack), strict=True):
                rows = len(series.ts)
                for lo in range(0, rows, STACK_ROWS):
                    hi = min(rows, lo + STACK_ROWS)
                    cols = []
                    for k, name in enumerate(names):
                        if k < n_keys:
                            cols.append(pa.array([series.keys[k]] * (hi - lo), arrow[name]))
                        elif name == spec.ts:
                            cols.append(series.ts.slice(lo, hi - lo).combine_chunks().cast(arrow[name]))
                        elif name == "t":
                            cols.append(pa.array(np.arange(lo + 1, hi + 1), pa.int64()))
                        elif name == "y":
                            cols.append(_nested(series.y[lo:hi], 1))
                        else:
                            cols.append(_nested(got[name][lo:hi], rank(kinds[name])))
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    return go


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _stacked(series: list[Series], run: Callable[[np.ndarray, np.ndarray | None, np.ndarray | None], dict[str, np.ndarray]]) -> list[dict[str, np.ndarray]]:
    """Runs once for all series of one length."""
    out: list[dict[str, np.ndarray]] = [{}] * len(series)
    lengths = np.array([len(s.y) for s in series])
    for size in np.unique(lengths):
        own = np.flatnonzero(lengths == size)
        pick = lambda name, own=own: None if getattr(series[own[0]], name) is None else np.stack([getattr(series[k], name) for k in own])
        got = run(pick("y"), pick("u"), pick("x"))
        for i, k in enumerate(own):
            out[k] = {name: v[i] for name, v in got.items()}
    return out


def _kernel(model: StateSpaceModel, prior: GaussianState | None, outputs: tuple[str, ...]) -> Callable[[list[Series]], list[dict[str, np.ndarray]]]:
    smooth = any(o in SMOOTHED for o in outputs)
    plans: dict[int, kernels.Moments] = {}

    def run(y: np.ndarray, u: np.ndarray | None, x: np.ndarray | None) -> dict[str, np.ndarray]:
        if u is None and x is None and not np.isnan(y).any():
            # No gaps: the gains are the same for all series of this length.
            if y.shape[1] not in plans:
                if len(plans) > 16:
                    plans.clear()
                plans[y.shape[1]] = kernels.steady_plan(model, y.shape[1], prior)
            m = kernels.complete_scan(model, y, plans[y.shape[1]], prior)
        else:
            m = kernels.kalman_scan(model, y, prior, u, x)
        got = {k: v for k, v in m._asdict().items() if k in outputs}
        if smooth:
            got["smooth_mean"], got["smooth_cov"], _ = kernels.rts(model, m)
        return {k: got[k] for k in outputs}

    return lambda series: _stacked(series, run)


def _rows_schema(df: DataFrame, spec: SeriesSpec, outputs: tuple[str, ...]) -> T.StructType:
    kinds = OUTPUTS | SMOOTHED
    unknown = [o for o in outputs if o not in kinds]
    if unknown:
        raise ValueError(f"Unknown outputs: {unknown}; choose from {list(kinds)}")
    fields = [T.StructField(k, df.schema[k].dataType) for k in (*spec.keys, spec.ts)]
    return T.StructType([*fields, T.StructField("t", T.LongType()), T.StructField("y", VECTOR), *(T.StructField(o, kinds[o]) for o in outputs)])


def filter_series(df: DataFrame, spec: SeriesSpec, model: StateSpaceModel, prior: GaussianState | None = None, outputs: tuple[str, ...] = tuple(OUTPUTS), partitions: int | None = None, stack_rows: int = STACK_ROWS) -> DataFrame:
    """One row per observation: keys, ts, t (from 1), y, and the chosen outputs."""
    schema = _rows_schema(df, spec, outputs)
    return _ordered(df, spec, partitions).mapInArrow(_emit(spec, schema, _kernel(model, prior, outputs), stack_rows), schema)


def smooth_series(df: DataFrame, spec: SeriesSpec, model: StateSpaceModel, prior: GaussianState | None = None, outputs: tuple[str, ...] = (*OUTPUTS, *SMOOTHED), partitions: int | None = None, stack_rows: int = STACK_ROWS) -> DataFrame:
    """filter_series() with the smoothed moments: forward and backward in one kernel, one exchange."""
    return filter_series(df, spec, model, prior, outputs, partitions, stack_rows)


def nonlinear_series(df: DataFrame, spec: SeriesSpec, model: NonlinearSSM, kind: str = "ekf", prior: GaussianState | None = None, outputs: tuple[str, ...] = tuple(OUTPUTS), partitions: int | None = None, **options) -> DataFrame:
    """The extended ('ekf') or unscented ('ukf') filter of every series; options alpha, beta, kappa, sigma of the latter."""
    if kind not in ("ekf", "ukf"):
        raise ValueError(f"Unknown filter: {kind!r}. Use 'ekf' or 'ukf'.")

    def run(series: list[Series]) -> list[dict[str, np.ndarray]]:
        scan = kernels.ekf_scan if kind == "ekf" else lambda m, y, p: kernels.ukf_scan(m, y, p, **options)
        return [{k: v[0] for k, v in scan(model, s.y, prior)._asdict().items() if k in outputs} for s in series]

    schema = _rows_schema(df, spec, outputs)
    return _ordered(df, spec, partitions).mapInArrow(_emit(spec, schema, run, STACK_ROWS), schema)


def _per_series(df: DataFrame, spec: SeriesSpec, fields: list[tuple[str, T.DataType]], run: Callable[[list[Series]], list[tuple]], partitions: int | None) -> DataFrame:
    """One row per series: keys and the fields."""
    schema = T.StructType([*(T.StructField(k, df.schema[k].dataType) for k in spec.keys), *(T.StructField(n, k) for n, k in fields)])
    arrow = [_arrow(f.dataType) for f in schema.fields]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stack in _stream(batches, len(spec.keys), STACK_ROWS):
            rows = [(*s.keys, *r) for s, r in zip(stack, run(stack), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), arrow, strict=True)], names=schema.names)

    return _ordered(df, spec, partitions).mapInArrow(go, schema)


def last_state(df: DataFrame, spec: SeriesSpec, model: StateSpaceModel, prior: GaussianState | None = None, partitions: int | None = None) -> DataFrame:
    """One row per series: keys, n_obs, last_ts, log_likelihood, mean, cov after the last observation; status 'ok' or 'singular'."""

    def run(series: list[Series]) -> list[tuple]:
        got = _kernel(model, prior, ("filt_mean", "filt_cov", "ll"))(series)
        out = []
        for s, g in zip(series, got, strict=True):
            ok = np.isfinite(g["filt_cov"][-1]).all()
            out.append((len(s.y), s.ts[len(s.y) - 1].as_py(), float(g["ll"].sum()), g["filt_mean"][-1].tolist(), g["filt_cov"][-1].tolist(), "ok" if ok else "singular"))
        return out

    fields = [("n_obs", T.LongType()), ("last_ts", df.schema[spec.ts].dataType), ("log_likelihood", T.DoubleType()), ("mean", VECTOR), ("cov", MATRIX), ("status", T.StringType())]
    return _per_series(df, spec, fields, run, partitions)


#: Beyond, unrolled products would make a plan of thousands of terms.
EXPRESSION_STATES = 3


def _forecast_kernel(states: DataFrame, model: StateSpaceModel, steps: int) -> DataFrame:
    extra = [("h", T.IntegerType()), ("state_mean", VECTOR), ("state_cov", MATRIX), ("obs_mean", VECTOR), ("obs_cov", MATRIX)]
    schema = T.StructType([*states.schema.fields, *(T.StructField(n, k) for n, k in extra)])
    names = states.columns
    maps = kernels.forecast_maps(model, steps)
    power, noise = np.stack([g for g, _ in maps]), np.stack([s for _, s in maps])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = max(1, STACK_ROWS // (steps * model.state_dim))
            for lo in range(0, batch.num_rows, most):
                part = batch.slice(lo, most)
                size = part.num_rows
                mean = np.array(part.column(names.index("mean")).to_pylist(), float)
                cov = np.array(part.column(names.index("cov")).to_pylist(), float)
                ahead = np.einsum("hij,sj->shi", power, mean)
                spread = power[None] @ cov[:, None] @ np.swapaxes(power, -1, -2)[None] + noise[None]
                seen, around = ahead @ model.F.T, model.F @ spread @ model.F.T + model.V
                rows = pa.array(np.repeat(np.arange(size), steps))
                flat = lambda v: v.reshape(size * steps, *v.shape[2:])
                yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in part.columns), pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), size)), _nested(flat(ahead), 1), _nested(flat(spread), 2), _nested(flat(seen), 1), _nested(flat(around), 2)], names=schema.names)

    return states.mapInArrow(go, schema)


def forecast_states(states: DataFrame, model: StateSpaceModel, steps: int) -> DataFrame:
    """Rows of states (with columns mean, cov) times h = 1 .. steps: state_mean, state_cov, obs_mean, obs_cov.  The powers of G and the
    gathered noise depend on the model alone.  Up to EXPRESSION_STATES states the algebra is expressions over a broadcast table of
    `steps` rows; larger ones are multiplied in NumPy, batch by batch."""
    if model.state_dim > EXPRESSION_STATES:
        return _forecast_kernel(states, model, steps)
    maps = kernels.forecast_maps(model, steps)
    n, m = model.state_dim, model.obs_dim
    spark = states.sparkSession
    rows = [(h + 1, (g).tolist(), s.tolist()) for h, (g, s) in enumerate(maps)]
    table = spark.createDataFrame(rows, T.StructType([T.StructField("h", T.IntegerType()), T.StructField("_g", MATRIX), T.StructField("_s", MATRIX)]))
    at = lambda c, *ij: F.element_at(F.element_at(c, ij[0] + 1), ij[1] + 1) if len(ij) == 2 else F.element_at(c, ij[0] + 1)
    total = lambda terms: sum(terms[1:], terms[0])
    joined = states.join(F.broadcast(table))
    mean = F.array(*[total([at("_g", i, k) * at("mean", k) for k in range(n)]) for i in range(n)])
    gc = F.array(*[F.array(*[total([at("_g", i, k) * at("cov", k, j) for k in range(n)]) for j in range(n)]) for i in range(n)])
    joined = joined.withColumns({"state_mean": mean, "_gc": gc})
    cov = F.array(*[F.array(*[total([at("_gc", i, k) * at("_g", j, k) for k in range(n)]) + at("_s", i, j) for j in range(n)]) for i in range(n)])
    joined = joined.withColumn("state_cov", cov)
    f, v = model.F, model.V
    obs_mean = F.array(*[total([F.lit(float(f[a, k])) * at("state_mean", k) for k in range(n)]) for a in range(m)])
    obs_cov = F.array(*[F.array(*[total([F.lit(float(f[a, i] * f[b, j])) * at("state_cov", i, j) for i in range(n) for j in range(n) if f[a, i] * f[b, j]] or [F.lit(0.0)]) + F.lit(float(v[a, b])) for b in range(m)]) for a in range(m)])
    return joined.withColumns({"obs_mean": obs_mean, "obs_cov": obs_cov}).drop("_g", "_s", "_gc")


def forecast_series(df: DataFrame, spec: SeriesSpec, model: StateSpaceModel, steps: int, prior: GaussianState | None = None, freq: str | None = None, level: float = 0.95, partitions: int | None = None) -> DataFrame:
    """keys, h, ts (of freq D, W, ME, QE or YE; null without), component, mean, lower, upper, variance."""
    states = last_state(df, spec, model, prior, partitions)
    ahead = forecast_states(states, model, steps)
    rows = ahead.select(*spec.keys, "h", continue_dates(F.col("last_ts"), F.col("h"), freq).alias("ts"), F.posexplode("obs_mean").alias("component", "mean"), "obs_cov")
    variance = F.element_at(F.element_at("obs_cov", F.col("component") + 1), F.col("component") + 1)
    return with_bands(rows.withColumn("variance", variance).drop("obs_cov"), "mean", "variance", level)


def with_bands(df: DataFrame, mean: str, variance: str, level: float = 0.95, lower: str = "lower", upper: str = "upper") -> DataFrame:
    half = F.lit(kernels.z_score(level)) * F.sqrt(F.col(variance))
    return df.withColumns({lower: F.col(mean) - half, upper: F.col(mean) + half})


_STEPS = {"ME": 1, "M": 1, "QE": 3, "Q": 3, "YE": 12, "Y": 12}


def infer_freq(df: DataFrame, spec: SeriesSpec) -> str | None:
    """D, W, ME, QE or YE by the median gap of dates within the series; None without dates or for other gaps."""
    if spec.ts not in df.columns or not isinstance(df.schema[spec.ts].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return None
    order = Window.partitionBy(*spec.keys).orderBy(spec.ts)
    gap = F.datediff(spec.ts, F.lag(spec.ts).over(order))
    days = df.select(gap.alias("d")).agg(F.percentile_approx("d", 0.5, 1000)).first()[0]
    spans = {"D": (1, 1), "W": (7, 7), "ME": (28, 31), "QE": (89, 92), "YE": (365, 366)}
    return next((f for f, (a, b) in spans.items() if days is not None and a <= days <= b), None)


def continue_dates(last, h, freq: str | None):
    """The h-th date after `last`: D and W add days; ME, QE and YE go from month end to month end."""
    if freq is None:
        return F.lit(None).cast("date")
    if freq in _STEPS:
        return F.last_day(F.add_months(last.cast("date"), (h * _STEPS[freq]).cast("int")))
    if freq in ("D", "W"):
        return F.date_add(last.cast("date"), (h * (7 if freq == "W" else 1)).cast("int"))
    raise ValueError(f"Unknown freq: {freq!r}. Use D, W, ME, QE or YE.")


def fit_mle_series(df: DataFrame, spec: SeriesSpec, model_fn: Callable[[np.ndarray], StateSpaceModel], init_params: list[float], max_iter: int = 500, tol: float = 1e-6, partitions: int | None = None) -> DataFrame:
    """Each series' own parameters, the optimizer running in its task: keys, params, log_likelihood, n_iterations, converged, model (JSON)."""

    def run(series: list[Series]) -> list[tuple]:
        got = [fit_mle(model_fn, s.y, init_params, max_iter, tol) for s in series]
        return [(r.params.tolist(), r.log_likelihood, r.n_iterations, r.converged, r.model.to_json()) for r in got]

    return _per_series(df, spec, [("params", VECTOR), ("log_likelihood", T.DoubleType()), ("n_iterations", T.LongType()), ("converged", T.BooleanType()), ("model", T.StringType())], run, partitions)


def fit_em_series(df: DataFrame, spec: SeriesSpec, initial_model: StateSpaceModel, max_iter: int = 100, tol: float = 1e-6, m_step: str = "approx", partitions: int | None = None) -> DataFrame:
    """keys, log_likelihood, n_iterations, converged, history, model (JSON) of each series."""

    def run(series: list[Series]) -> list[tuple]:
        got = [fit_em(s.y, initial_model, max_iter, tol, m_step) for s in series]
        return [(r.log_likelihood, r.n_iterations, r.converged, r.log_likelihood_history, r.model.to_json()) for r in got]

    return _per_series(df, spec, [("log_likelihood", T.DoubleType()), ("n_iterations", T.LongType()), ("converged", T.BooleanType()), ("history", VECTOR), ("model", T.StringType())], run, partitions)


def fit_mle_pooled(df: DataFrame, spec: SeriesSpec, model_fn: Callable[[np.ndarray], StateSpaceModel], init_params: list[float], max_iter: int = 100, tol: float = 1e-6, partitions: int | None = None):
    """One set of parameters for all series: a loop on the driver, one job for each gradient, over the ordered rows, which are kept.
    All points of a gradient are filtered in one pass."""
    ordered = _ordered(df, spec, partitions).persist()

    def losses(points: list[np.ndarray]) -> list[float]:
        models = [model_fn(p) for p in points]

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(models))
            for stack in _stream(batches, len(spec.keys), STACK_ROWS):
                for k, model in enumerate(models):
                    sums[k] += sum(float(g["ll"].sum()) for g in _kernel(model, None, ("ll",))(stack))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models))), pa.array(sums)], names=["k", "ll"])

        got = dict(ordered.mapInArrow(go, "k long, ll double").groupBy("k").agg(F.sum("ll").alias("ll")).collect())
        return [-got.get(k, 0.0) if np.isfinite(got.get(k, 0.0)) else 1e300 for k in range(len(models))]

    def gradient(x: np.ndarray) -> np.ndarray:
        step = 1e-5 * np.maximum(1.0, np.abs(x))
        sides = [x + sign * step[k] * e for k, e in enumerate(np.eye(len(x))) for sign in (1, -1)]
        v = losses(sides)
        return np.array([(v[2 * k] - v[2 * k + 1]) / (2 * step[k]) for k in range(len(x))])

    try:
        return lbfgs(lambda x: losses([x])[0], init_params, gradient, max_iter, tol)
    finally:
        ordered.unpersist()


def pacf_column(df: DataFrame, keys: list[str], acf: str = "acf", lag: str = "lag") -> DataFrame:
    """Partial autocorrelations from rows (keys, lag, acf): the few values of a key are put together and solved."""
    gathered = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(lag, acf))).alias("r"))
    solve = F.pandas_udf(lambda s: s.map(lambda r: pacf_from_acf(np.array([v[acf] for v in r], float)).tolist()), "array<double>")
    return gathered.select(*keys, F.posexplode(solve("r")).alias(lag, "pacf"))


def p_value(q, df: int):
    """Upper chi-square tail as a column: a finite sum for an even df, else a vectorised function."""
    if df % 2 == 0:
        half, terms, factor = q / 2, F.lit(1.0), 1.0
        for i in range(1, df // 2):
            factor /= i
            terms = terms + F.pow(half, F.lit(float(i))) * F.lit(factor)
        return F.exp(-half) * terms
    return F.pandas_udf(lambda s: s.map(lambda v: chi2_sf(v, df)), "double")(q)


def summary_series(df: DataFrame, spec: SeriesSpec, model: StateSpaceModel, prior: GaussianState | None = None, n_lags: int = 10, partitions: int | None = None) -> DataFrame:
    """One row per series: n_obs, n_missing, log_likelihood, aic, resid_mean, resid_std (first component), lb_q, lb_p (null with too few residuals)."""

    def run(series: list[Series]) -> list[tuple]:
        out = []
        for s, g in zip(series, _kernel(model, prior, ("innov", "innov_cov", "ll"))(series), strict=True):
            z = g["innov"][:, 0] / np.sqrt(g["innov_cov"][:, 0, 0])
            z = z[~np.isnan(z)]
            ll = float(g["ll"].sum())
            q, p = ljung_box(z, n_lags) if len(z) > n_lags else (None, None)
            out.append((len(s.y), int(np.isnan(s.y).any(1).sum()), ll, -2 * ll + 2 * model.state_dim, float(z.mean()) if len(z) else None, float(z.std()) if len(z) else None, q, p))
        return out

    d = T.DoubleType()
    return _per_series(df, spec, [("n_obs", T.LongType()), ("n_missing", T.LongType()), ("log_likelihood", d), ("aic", d), ("resid_mean", d), ("resid_std", d), ("lb_q", d), ("lb_p", d)], run, partitions)


