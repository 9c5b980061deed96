"""Exact quantiles, also on the path for groups too large for one task."""

import numpy as np
import pandas as pd
import pytest

from labelscape.functions import normalize as nz
from labelscape.functions import quantiles as qt
from pyspark.sql import functions as F


def table(spark, n=3000, seed=0):
    rng = np.random.default_rng(seed)
    values = np.where(rng.random(n) < 0.3, 0.0, rng.lognormal(0, 3, n))
    return pd.DataFrame({"g": rng.choice(["p", "q"], n, p=[0.9, 0.1]), "v": values, "w": rng.uniform(0, 2, n)})


@pytest.mark.parametrize("small_rows", [10**6, 50])
def test_linear_quantiles(spark, small_rows):
    pdf = table(spark)
    got = qt.quantile(spark.createDataFrame(pdf), ["g"], "v", {"a": 0.13, "b": 0.5, "c": 0.99}, small_rows=small_rows).toPandas()
    for r in got.itertuples():
        assert np.allclose([r.a, r.b, r.c], pdf[pdf.g == r.g].v.quantile([0.13, 0.5, 0.99]), rtol=1e-12)


@pytest.mark.parametrize("small_rows", [10**6, 50])
def test_weighted_quantiles(spark, small_rows):
    pdf = table(spark)
    got = qt.weighted_quantile(spark.createDataFrame(pdf), ["g"], "v", "w", 0.9, small_rows=small_rows).toPandas()
    for r in got.itertuples():
        own = pdf[pdf.g == r.g].sort_values("v")
        cum = own.w.cumsum()
        assert r.value == own.v[cum >= 0.9 * own.w.sum()].iloc[0]


def test_implicit_zeros_by_count(spark):
    df = spark.createDataFrame([("a", 0.0, 7), ("a", 4.0, 1), ("a", 8.0, 2)], "g string, v double, n long")
    got = qt.quantile(df, ["g"], "v", {"m": 0.5, "t": 0.95}, freq="n").first()
    assert (got.m, got.t) == (np.quantile([0] * 7 + [4, 8, 8], 0.5), np.quantile([0] * 7 + [4, 8, 8], 0.95))


def test_weighted_median_is_not_interpolated(spark):
    df = spark.createDataFrame([(v, 1.0, 0.0) for v in (1.0, 2.0, 3.0, 10.0)], "v double, w double, z double")
    assert qt.weighted_quantile(df, [], "v", "w", 0.5).first().value == 2
    assert qt.weighted_quantile(df, [], "v", "z", 0.5).first().value == 2.5
    assert qt.weighted_quantile(df, [], "v", None, 0.5).first().value == 2.5


def test_trimmed_mean_and_unknown_method(spark):
    df = spark.createDataFrame([("a", float(v), 1.0) for v in [0, 1, 2, 3, 4, 5, 6, 7, 8, 100]], "g string, v double, w double")
    assert qt.aggregate_weighted(df, ["g"], "v", "w", "weighted_trimmed_mean").first().value == pytest.approx(4)
    assert qt.aggregate_weighted(df, ["g"], "v", "w", "mean").first().value == pytest.approx(13.6)
    with pytest.raises(ValueError):
        qt.aggregate_weighted(df, ["g"], "v", "w", "mode")
    with pytest.raises(ValueError, match="Unknown agg"):
        qt.aggregate_distances(df, ["g"], "v", "w", agg="mode")


def test_constant_series_scale_to_zero_or_one(spark):
    for constant, want in ((0.0, 0.0), (5.0, 1.0)):
        df = spark.createDataFrame([(constant,), (constant,)], "v double")
        assert [r.v for r in nz.scale_to_unit(df, "v").collect()] == [want, want]
        limits = nz.winsor_limits(df.withColumn("k", F.lit(1)), ["k"], "v")
        assert limits.first().flat == want


def test_winsorised_clips_above_only(spark):
    pdf = pd.DataFrame({"k": 1, "v": np.append(np.arange(100.0), 10_000.0)})
    df = spark.createDataFrame(pdf)
    got = df.join(nz.winsor_limits(df, ["k"], "v"), "k").withColumn("s", nz.winsorised(F.col("v"))).toPandas()
    clipped = np.minimum(pdf.v, np.quantile(pdf.v, 0.99))
    assert np.allclose(got.sort_values("v").s, clipped / clipped.max())


def test_text_and_missing_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(nz.number("v")).collect()] == [1.5, 0.0, 0.0]


def test_geometric_mean_floor(spark):
    ones = [F.lit(1.0)] * 6
    row = spark.range(1).select(nz.geometric_mean(ones).alias("a"), nz.geometric_mean([F.lit(0.0), *ones[1:]]).alias("b")).first()
    assert row.a == pytest.approx(1 + 1e-8) and row.b == pytest.approx(1e-8 ** (1 / 6), rel=1e-6)
