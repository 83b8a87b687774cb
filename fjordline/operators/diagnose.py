"""Diagnostics over DataFrames as built-in windows and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fjordline.operators.prepare import join_keys

from fjordline.operators.series import p_value


def residuals(filtered: DataFrame, to: str = "resid", component: int = 0) -> DataFrame:
    """filter_series() rows with the standardized residual of one observed component; null where y is missing."""
    k = component + 1
    z = F.try_divide(F.element_at("innov", k), F.sqrt(F.element_at(F.element_at("innov_cov", k), k)))
    return filtered.withColumn(to, F.when(~F.isnan(z), z))


def acf(df: DataFrame, keys: list[str], ts: str, value: str, n_lags: int = 20) -> DataFrame:
    """(keys, lag, acf, n): biased autocorrelations of the values that aren't null, all lags in one pass over one window; null beyond lag 0 where nothing varies."""
    order = Window.partitionBy(*keys).orderBy(ts)
    rows = df.where(F.col(value).isNotNull()).withColumn("_c", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))
    rows = rows.select(*keys, "_c", *[F.lag("_c", k).over(order).alias(f"_l{k}") for k in range(1, n_lags + 1)])
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("_v"), *[F.coalesce(F.sum(F.col("_c") * F.col(f"_l{k}")), F.lit(0.0)).alias(f"_s{k}") for k in range(1, n_lags + 1)])
    pairs = F.array(F.struct(F.lit(0).alias("lag"), F.lit(1.0).alias("acf")), *[F.struct(F.lit(k).alias("lag"), F.try_divide(f"_s{k}", "_v").alias("acf")) for k in range(1, n_lags + 1)])
    return sums.select(*keys, "n", F.explode(pairs).alias("p")).select(*keys, "p.lag", "p.acf", "n")


def ljung_box(correlations: DataFrame, keys: list[str], n_lags: int = 10) -> DataFrame:
    """(keys, lb_q, lb_p) from acf() rows of at least n_lags lags; null for series of n_lags values or fewer."""
    n = F.col("n")
    terms = F.sum(F.when(F.col("lag").between(1, n_lags), F.col("acf") * F.col("acf") / (n - F.col("lag"))))
    got = correlations.where(n > n_lags).groupBy(*keys, "n").agg(terms.alias("_s"))
    return got.select(*keys, (n * (n + 2) * F.col("_s")).alias("lb_q")).withColumn("lb_p", p_value(F.col("lb_q"), n_lags))


def running_likelihood(filtered: DataFrame, keys: list[str]) -> DataFrame:
    """The log-likelihood up to each row."""
    return filtered.withColumn("cum_ll", F.sum("ll").over(Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))


def fit_summary(filtered: DataFrame, keys: list[str], state_dim: int) -> DataFrame:
    """(keys, n_obs, log_likelihood, aic, resid_mean, resid_std) from filter_series() rows."""
    z = residuals(filtered)
    got = z.groupBy(*keys).agg(F.count("*").alias("n_obs"), F.sum("ll").alias("log_likelihood"), F.avg("resid").alias("resid_mean"), F.stddev_pop("resid").alias("resid_std"))
    return got.withColumn("aic", -2 * F.col("log_likelihood") + 2 * state_dim)


def qq_points(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sorted values beside the probabilities (i - 1/2) / n."""
    own = Window.partitionBy(*keys)
    rows = df.where(F.col(value).isNotNull())
    return rows.select(*keys, F.row_number().over(own.orderBy(value)).cast("long").alias("i"), F.count("*").over(own).alias("n"), F.col(value).alias("sample")).withColumn("prob", (F.col("i") - 0.5) / F.col("n"))


def histogram(df: DataFrame, keys: list[str], value: str, bins: int = 25) -> DataFrame:
    """(keys, bin, count, density, left, right): equal bins from the least to the largest value of a key, the last one closed."""
    rows = df.where(F.col(value).isNotNull())
    ends = rows.groupBy(*keys).agg(F.min(value).alias("_a"), F.max(value).alias("_b"), F.count("*").alias("_n"))
    joined = join_keys(rows, ends, keys) if keys else rows.crossJoin(F.broadcast(ends))  # one row of ends without keys
    width = (F.col("_b") - F.col("_a")) / bins
    k = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_a")) / width))).otherwise(F.lit(0)).cast("long")
    counted = joined.groupBy(*keys, "_a", "_b", "_n", k.alias("bin")).agg(F.count("*").alias("count"))
    return counted.select(*keys, "bin", "count", F.when(width > 0, F.col("count") / (F.col("_n") * width)).alias("density"), (F.col("_a") + F.col("bin") * width).alias("left"), (F.col("_a") + (F.col("bin") + 1) * width).alias("right"))
