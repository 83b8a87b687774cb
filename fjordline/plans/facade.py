"""One object from data to forecast: SparkDLM over any number of series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordline.operators import diagnose, plot_data
from fjordline.operators.series import SeriesSpec, fit_mle_series, filter_series, forecast_series, infer_freq, last_state, smooth_series, summary_series
from fjordline.plans.model import GaussianState, StateSpaceModel


class SparkDLM:
    """fit() and smooth() build lazy plans; nothing runs before an action.  Methods that need an earlier one raise RuntimeError."""

    def __init__(self, model: StateSpaceModel) -> None:
        self._model = model
        self._clear()

    def _clear(self) -> None:
        self._df = self._spec = self._prior = self._freq = None
        self._filtered = self._smoothed = self._forecast = None

    @property
    def model(self) -> StateSpaceModel:
        return self._model

    @property
    def filter_result(self) -> DataFrame:
        if self._filtered is None:
            raise RuntimeError("Model not fitted. Call .fit() first.")
        return self._filtered

    @property
    def smoother_result(self) -> DataFrame:
        if self._smoothed is None:
            raise RuntimeError("Model not smoothed. Call .smooth() first.")
        return self._smoothed

    def fit(self, df: DataFrame, spec: SeriesSpec, initial_state: GaussianState | None = None, freq: str | None = None) -> SparkDLM:
        """Filters; forgets earlier smoothing and forecasts.  freq (D, W, ME, QE, YE) dates the forecasts; without, it is that of the median gap."""
        self._clear()
        self._df, self._spec, self._prior, self._freq = df, spec, initial_state, freq
        self._filtered = filter_series(df, spec, self._model, initial_state)
        return self

    def smooth(self) -> SparkDLM:
        self.filter_result  # noqa: B018
        self._smoothed = smooth_series(self._df, self._spec, self._model, self._prior)
        return self

    def forecast(self, steps: int = 1) -> DataFrame:
        """keys, h, ts, component, mean, lower_95, upper_95."""
        self.filter_result  # noqa: B018
        if self._freq is None:
            self._freq = infer_freq(self._df, self._spec)
        got = forecast_series(self._df, self._spec, self._model, steps, self._prior, self._freq)
        self._forecast = got.withColumnsRenamed({"lower": "lower_95", "upper": "upper_95"})
        return self._forecast

    def forecast_smoothed(self, steps: int = 1) -> DataFrame:
        """The same: the last smoothed belief is the last filtered one."""
        self.smoother_result  # noqa: B018
        return self.forecast(steps)

    def fit_batch(self, df: DataFrame, spec: SeriesSpec) -> DataFrame:
        """The filter of other series; leaves this object as it is."""
        return filter_series(df, spec, self._model)

    def fit_mle(self, df: DataFrame, spec: SeriesSpec, model_fn, init_params: list[float], **options) -> DataFrame:
        return fit_mle_series(df, spec, model_fn, init_params, **options)

    def residuals(self) -> DataFrame:
        return diagnose.residuals(self.filter_result).select(*self._spec.keys, self._spec.ts, "t", "resid")

    def ljung_box(self, n_lags: int = 10) -> DataFrame:
        keys = list(self._spec.keys)
        return diagnose.ljung_box(diagnose.acf(self.residuals(), keys, "t", "resid", n_lags), keys, n_lags)

    def last_state(self) -> DataFrame:
        self.filter_result  # noqa: B018
        return last_state(self._df, self._spec, self._model, self._prior)

    def fit_summary(self) -> DataFrame:
        self.filter_result  # noqa: B018
        return summary_series(self._df, self._spec, self._model, self._prior)

    def summary(self) -> str:
        """A text block; figures for a single series, a count for many (see fit_summary)."""
        lines = ["DLM Summary", "=" * 40, f"State dim:       {self._model.state_dim}", f"Observation dim: {self._model.obs_dim}", f"Has input (B):   {self._model.B is not None}"]
        if self._filtered is None:
            lines.append("(not fitted)")
        else:
            rows = self.fit_summary().take(2)
            if len(rows) == 1:
                r = rows[0]
                lines += [f"Observations:    {r.n_obs}", f"Log-likelihood:  {r.log_likelihood:.4f}", f"AIC:             {r.aic:.4f}", f"Residual mean:   {r.resid_mean:.4f}", f"Residual std:    {r.resid_std:.4f}"]
                if r.lb_q is not None:
                    lines.append(f"Ljung-Box(10):   Q={r.lb_q:.2f}, p={r.lb_p:.4f}")
            else:
                lines.append("Several series: see fit_summary()")
        return "\n".join([*lines, "=" * 40])

    def _states(self, rows: DataFrame, column: str) -> DataFrame:
        return rows.select(*self._spec.keys, self._spec.ts, "t", *[F.col(column)[i].alias(f"state_{i}") for i in range(self._model.state_dim)])

    def filtered_states_df(self) -> DataFrame:
        return self._states(self.filter_result, "filt_mean")

    def smoothed_states_df(self) -> DataFrame:
        return self._states(self.smoother_result, "smooth_mean")

    def plot_data(self, kind: str = "filtered", **options) -> DataFrame:
        """What a plot of that kind draws, as rows: filtered, smoothed, forecast, diagnostics, components or panel."""
        spec = self._spec
        if kind == "filtered":
            return plot_data.fitted(self.filter_result, spec, self._model, "filt", **options)
        if kind == "smoothed":
            return plot_data.fitted(self.smoother_result, spec, self._model, "smooth", **options)
        if kind == "forecast":
            if self._forecast is None:
                raise RuntimeError("No forecast available. Call .forecast() first.")
            return plot_data.forecast(self.filter_result, self._forecast, spec, **options)
        if kind == "diagnostics":
            return plot_data.diagnostics(self.filter_result, spec, **options)
        if kind == "components":
            if self._smoothed is None:
                self.smooth()
            return plot_data.components(self.smoother_result, spec, **options)
        if kind == "panel":
            return plot_data.panel(self.filter_result, self._smoothed, self._forecast, spec, self._model, **options)
        raise ValueError(f"Unknown plot kind: {kind!r}. Use 'filtered', 'smoothed', 'forecast', 'diagnostics', 'components' or 'panel'.")

    def __repr__(self) -> str:
        return f"SparkDLM(state_dim={self._model.state_dim}, obs_dim={self._model.obs_dim}, {'fitted' if self._filtered is not None else 'not fitted'})"
