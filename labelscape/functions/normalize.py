"""Scaling rules, written as window or join expressions over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscape.functions.quantiles import quantile


def number(column: str | Column, default: float | None = 0.0) -> Column:
    """Cast to double; text that is no number, NULL and NaN become ``default``."""
    c = F.col(column) if isinstance(column, str) else column
    value = c.try_cast("double")
    value = F.when(~F.isnan(value), value)
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def is_close(a: Column, b: Column) -> Column:
    """Relative closeness at 1e-9, as for plain floats."""
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * 1e-9


def shifted_nonnegative(df: DataFrame, column: str) -> DataFrame:
    """Numbers, moved up as a whole by the frame's minimum if that is negative."""
    value = number(column)
    low = df.agg(F.least(F.min(value), F.lit(0.0))).scalar()
    return df.withColumn(column, F.greatest(value - F.coalesce(low, F.lit(0.0)), F.lit(0.0)))


def min_max(value: Column, over) -> Column:
    """(v - min) / (max - min) in the window; a constant 0 gives 0, any other constant 1."""
    low, high = F.min(value).over(over), F.max(value).over(over)
    return F.when(is_close(low, high), F.when(high == 0, 0.0).otherwise(1.0)).otherwise(
        (value - low) / (high - low))


def min_max_positive(value: Column, over) -> Column:
    """Min-max in the window; a constant above 0 gives 1, any other constant 0."""
    low, high = F.min(value).over(over), F.max(value).over(over)
    return F.when(low == high, F.when(high > 0, 1.0).otherwise(0.0)).otherwise(
        (value - low) / (high - low))


def scale_to_unit(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Min-max of one column over the whole table, by two scalar subqueries."""
    value = number(column)
    low, high = df.agg(F.min(value)).scalar(), df.agg(F.max(value)).scalar()
    scaled = F.when(is_close(low, high), F.when(high == 0, 0.0).otherwise(1.0)).otherwise(
        (value - low) / (high - low))
    return df.withColumn(out or column, scaled)


def winsor_limits(df: DataFrame, keys: list[str], value: str, *, upper: float = 0.99,
                  freq: str | None = None, bounded: bool = False) -> DataFrame:
    """Per group: ``low``, ``top`` (largest value after clipping at the upper quantile), ``flat``.

    ``flat`` is NULL for groups to be scaled as (v - low) / (top - low), else the value that
    every member gets: 0 for a group of zeros, 1 for any other constant group.
    """
    live = df.where(F.col(freq) > 0) if freq else df
    limits = quantile(live, keys, value, {"low": 0.0, "cut": upper, "high": 1.0}, freq=freq, bounded=bounded)
    top = F.greatest(F.least(F.col("cut"), F.col("high")), F.col("low"))
    same = (F.col("high") - F.col("low")) <= 1e-8 + 1e-5 * F.abs(F.col("low"))
    flat = F.when(same, F.when(F.col("low") == 0, 0.0).otherwise(1.0)).when(
        is_close(F.col("low"), top), F.when(top == 0, 0.0).otherwise(1.0))
    return limits.select(*keys, "low", top.alias("top"), flat.alias("flat"))


def winsorised(value: Column) -> Column:
    """Scaled value, given the columns of ``winsor_limits``."""
    return F.coalesce(F.col("flat"), (F.least(value, F.col("top")) - F.col("low")) / (F.col("top") - F.col("low")))


def robust_limits(df: DataFrame, keys: list[str], value: str, *, lower: float = 0.01, upper: float = 0.99,
                  freq: str | None = None) -> DataFrame:
    """Per group: ``lo`` and ``hi`` quantiles, and ``flat`` for groups where they coincide."""
    limits = quantile(df, keys, value, {"lo": lower, "hi": upper}, freq=freq)
    flat = F.when(is_close(F.col("lo"), F.col("hi")), F.when(F.col("hi") == 0, 0.0).otherwise(1.0))
    return limits.withColumn("flat", flat)


def robust_scaled(value: Column) -> Column:
    clipped = F.least(F.greatest(value, F.col("lo")), F.col("hi"))
    return F.coalesce(F.col("flat"), (clipped - F.col("lo")) / (F.col("hi") - F.col("lo")))


def geometric_mean(columns: list[Column], eps: float = 1e-8) -> Column:
    """exp(mean(ln(max(v, 0) + eps))): a zero lowers the result but never makes it 0."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.ln(F.greatest(c, F.lit(0.0)) + F.lit(eps))
    return F.exp(total / len(columns))


def whole(*keys: str):
    return Window.partitionBy(*keys)
