"""Small filters as one Catalyst expression: `aggregate` over each key's sorted observations, no Python.

The algebra of a model with one observed value and up to three states is unrolled to scalars, zeros and ones of
its matrices folded away.  Meant for series of up to some thousand rows when only the last state or the
likelihood is wanted, or a smoother of one state; longer series go to fjordline.operators.series.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjordline.plans.model import DIFFUSE, StateSpaceModel


def _number(v: float) -> str:
    v = float(v)
    return f"{v!r}D" if v >= 0 else f"({v!r}D)"


def _sum(terms: list[tuple[float, str]]) -> str:
    """coefficient x expression, added; zeros left out, ones implied."""
    parts = [e if c == 1.0 else f"-{e}" if c == -1.0 else f"{_number(c)} * {e}" for c, e in terms if c != 0.0]
    return "(" + " + ".join(parts) + ")" if parts else "0D"


def _pair(i: int, j: int) -> str:
    return f"c{min(i, j)}{max(i, j)}"


def step_fields(model: StateSpaceModel, y: str, s: str = "s", u: str | None = None) -> dict[str, str]:
    """The next state's fields m0.., c00.., ll from the state s and the observation y, as SQL; s also gets a predicted part."""
    n, g, f, w, v = model.state_dim, model.G, model.F[0], model.W, float(model.V[0, 0])
    if model.obs_dim != 1 or n > 3:
        raise ValueError("one observed value and up to three states, please")
    a = [_sum([(g[i, k], f"{s}.m{k}") for k in range(n)] + ([(float(model.B[i, 0]), u)] if u and model.B is not None else [])) for i in range(n)]
    r = {}
    for i in range(n):
        for j in range(i, n):
            terms = [(g[i, k] * g[j, q], f"{s}.{_pair(k, q)}") for k in range(n) for q in range(n)]
            r[i, j] = _sum(terms)[:-1] + f" + {_number(float(w[i, j]))})"
    q = lambda i, j: r[min(i, j), max(i, j)]
    cross = [_sum([(f[k], q(i, k)) for k in range(n)]) for i in range(n)]
    spread = "nullif(" + _sum([(f[i], cross[i]) for i in range(n)]) + f" + {_number(v)}, 0D)"  # null, not an error, where it is singular
    error = f"({y} - {_sum([(f[i], a[i]) for i in range(n)])})"
    gone = f"({y} is null or isnan({y}))"
    out = {f"m{i}": f"if({gone}, {a[i]}, {a[i]} + {cross[i]} / {spread} * {error})" for i in range(n)}
    out |= {f"c{i}{j}": f"if({gone}, {r[i, j]}, {r[i, j]} - {cross[i]} * {cross[j]} / {spread})" for i in range(n) for j in range(i, n)}
    out["ll"] = f"{s}.ll + if({gone}, 0D, -0.5D * ({_number(math.log(2 * math.pi))} + ln({spread}) + {error} * {error} / {spread}))"
    return out


def _struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def start_fields(model: StateSpaceModel, cov: float = DIFFUSE) -> dict[str, str]:
    n = model.state_dim
    return {f"m{i}": "0D" for i in range(n)} | {f"c{i}{j}": _number(cov if i == j else 0.0) for i in range(n) for j in range(i, n)} | {"ll": "0D"}


def gathered(df: DataFrame, keys: list[str], ts: str, y: str, u: str | None = None) -> DataFrame:
    """One row per key with its observations in order of ts."""
    cols = [F.col(ts).alias("ts"), F.col(y).cast("double").alias("y"), *([F.col(u).cast("double").alias("u")] if u else [])]
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("obs"))


def final_state(df: DataFrame, keys: list[str], model: StateSpaceModel, ts: str = "ts", y: str = "y", u: str | None = None) -> DataFrame:
    """One row per key: n, m0.., c00.. (upper triangle), ll after the last observation."""
    fields = step_fields(model, "o.y", "s", "o.u" if u else None)
    start = start_fields(model)
    fold = F.expr(f"aggregate(obs, {_struct(start)}, (s, o) -> {_struct(fields)})")
    return gathered(df, keys, ts, y, u).select(*keys, F.size("obs").cast("long").alias("n"), fold.alias("s")).select(*keys, "n", *[F.col(f"s.{k}").alias(k) for k in start])


_LEVEL_ROW = "array<struct<t:bigint,ts:timestamp,y:double,a:double,r:double,m:double,c:double,ll:double>>"


def level_rows(df: DataFrame, keys: list[str], model: StateSpaceModel, ts: str = "ts", y: str = "y", smooth: bool = False) -> DataFrame:
    """Every row of a one-state filter: t, ts, y, a, r (predicted), m, c (filtered), ll, and with smooth also s, p (smoothed)."""
    if model.state_dim != 1:
        raise ValueError("one state, please")
    fields = step_fields(model, "o.y", "s")
    g, w = float(model.G[0, 0]), float(model.W[0, 0])
    ahead = {"a": f"({_number(g)} * s.m0)", "r": f"({_number(g * g)} * s.c00 + {_number(w)})"}
    row = {"t": "s.t + 1L", "ts": "cast(o.ts as timestamp)", "y": "o.y", **ahead, "m": fields["m0"], "c": fields["c00"], "ll": fields["ll"].removeprefix("s.ll + ")}
    start = {**start_fields(model), "t": "0L", "out": f"cast(array() as {_LEVEL_ROW})"}
    after = {**fields, "t": "s.t + 1L", "out": f"concat(s.out, array({_struct(row)}))"}
    rows = gathered(df, keys, ts, y).select(*keys, F.expr(f"aggregate(obs, {_struct(start)}, (s, o) -> {_struct(after)}, s -> s.out)").alias("out"))
    if not smooth:
        return rows.select(*keys, F.explode("out").alias("o")).select(*keys, "o.*")
    kind = _LEVEL_ROW[:-2] + ",s:double,p:double>>"
    pick = lambda o, s, p: _struct({k: f"{o}.{k}" for k in ("t", "ts", "y", "a", "r", "m", "c", "ll")} | {"s": s, "p": p})
    gain = f"(o.c * {_number(g)} / nullif(x.r, 0D))"
    body = _struct({"a": "o.a", "r": "o.r", "s": f"o.m + {gain} * (x.s - x.a)", "p": f"o.c + {gain} * {gain} * (x.p - x.r)", "out": f"concat(x.out, array({pick('o', f'o.m + {gain} * (x.s - x.a)', f'o.c + {gain} * {gain} * (x.p - x.r)')}))"})
    last = "element_at(out, -1)"
    seed = _struct({"a": f"{last}.a", "r": f"{last}.r", "s": f"{last}.m", "p": f"{last}.c", "out": f"cast(array({pick(last, f'{last}.m', f'{last}.c')}) as {kind})"})
    back = rows.select(*keys, F.expr(f"aggregate(reverse(slice(out, 1, size(out) - 1)), {seed}, (x, o) -> {body}, x -> x.out)").alias("out"))
    return back.select(*keys, F.explode("out").alias("o")).select(*keys, "o.*")
