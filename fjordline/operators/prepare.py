"""Preparing series: resampling, calendars without gaps, regressors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resample(df: DataFrame, keys: list[str], ts: str, unit: str, **values: Column) -> DataFrame:
    """One row per key and period (unit of date_trunc): ts is its beginning, values are aggregates by name."""
    return df.groupBy(*keys, F.date_trunc(unit, ts).alias("ts")).agg(*[v.alias(k) for k, v in values.items()])


def fill_gaps(df: DataFrame, keys: list[str], unit: str, ts: str = "ts") -> DataFrame:
    """Adds the missing periods between each key's first and last: a row with null values.  unit is day, week, month, quarter or year."""
    step = F.expr({"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}[unit])
    ends = df.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    calendar = ends.select(*keys, F.explode(F.sequence("_a", "_b", step)).alias(ts))
    return join_keys(calendar, df, [*keys, ts], "left")


def join_keys(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys are equal, as they are in groups; the columns of `on` are told once, those of left."""
    other = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    return left.join(other, same, how).drop(*[f"_right_{c}" for c in on])


def number_rows(df: DataFrame, keys: list[str], ts: str = "ts", to: str = "t") -> DataFrame:
    return df.withColumn(to, F.row_number().over(Window.partitionBy(*keys).orderBy(ts)).cast("long"))


def as_of(df: DataFrame, other: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """df with the latest `value` of other at or before ts, by key: a union and a running last, no range join."""
    left = df.withColumns({"_v": F.lit(None).cast(other.schema[value].dataType), "_left": F.lit(True)})
    right = other.select(*keys, ts, F.col(value).alias("_v"), F.lit(False).alias("_left"))
    both = left.unionByName(right, allowMissingColumns=True)
    run = Window.partitionBy(*keys).orderBy(ts, F.col("_left").cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(run)).where("_left").drop("_v", "_left")


def observed(y: Column) -> Column:
    """y with NaN as null: missing either way."""
    return F.when(~F.isnan(y), y)
