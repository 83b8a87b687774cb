"""The filter as a streaming operator: each key's belief is kept as state and moved on by new observations.

A belief can't be rewound: rows whose ts isn't after the key's last are late; they change nothing and are told with late = true.
Within a micro-batch rows are put in order.  With ts a timestamp and a watermark on it, idle keys may be forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fjordline.functions import kernels
from fjordline.plans.model import GaussianState, StateSpaceModel

_STATE = "mean array<double>, cov array<double>, ll double, t long, last long"


def filter_stream(df: DataFrame, key: str, ts: str, y: str, model: StateSpaceModel, prior: GaussianState | None = None, idle: str | None = None) -> DataFrame:
    """Rows key, ts, t, y, mean, variance (of the observed value, filtered), ll, cum_ll, late.  One observed value; ts timestamp or long.
    idle: a duration in milliseconds after which a key's belief is dropped, measured by the watermark."""
    if model.obs_dim != 1:
        raise ValueError("one observed value, please")
    n, start = model.state_dim, prior or model.initial_state()
    kind = df.schema[ts].dataType
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(ts, kind), T.StructField("t", T.LongType()), T.StructField("y", T.DoubleType()), T.StructField("mean", T.DoubleType()), T.StructField("variance", T.DoubleType()), T.StructField("ll", T.DoubleType()), T.StructField("cum_ll", T.DoubleType()), T.StructField("late", T.BooleanType())])

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            mean, cov, total, t, last = state.get
            mean, cov = np.array(mean), np.array(cov).reshape(n, n)
        else:
            mean, cov, total, t, last = start.mean, start.cov, 0.0, 0, None
        rows = pd.concat(list(frames), ignore_index=True)
        number = rows[ts].astype("int64") if kind == T.LongType() else rows[ts].astype("datetime64[us]").astype("int64")
        rows = rows.assign(_n=number).sort_values("_n", kind="stable")
        out = []
        for when, order, value in zip(rows[ts], rows["_n"].tolist(), rows[y].astype(float), strict=True):
            late = last is not None and order <= last
            ll = 0.0
            if not late:
                mean_, cov_ = kernels.kalman_predict(mean[None], cov[None], model)
                mean_, cov_, _, _, got = kernels.kalman_update(mean_, cov_, np.array([[value]]), model)
                mean, cov, ll = mean_[0], cov_[0], float(got[0])
                total, t, last = total + ll, t + 1, order
            out.append((group[0], when, t, value, float(model.F[0] @ mean), float(model.F[0] @ cov @ model.F[0]), ll, total, late))
        state.update((mean.tolist(), cov.ravel().tolist(), float(total), int(t), int(last)))
        if idle:
            state.setTimeoutTimestamp(max(int(last // 1000), state.getCurrentWatermarkMs()) + int(idle))
        yield pd.DataFrame(out, columns=schema.names)

    timeout = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    picked = df.select(key, ts, F.col(y).cast("double").alias(y))
    return picked.groupBy(key).applyInPandasWithState(run, schema, _STATE, "append", timeout)
