"""Gene distance matrices on spots, by hand and by loops."""

import numpy as np
import pandas as pd
import pytest

from labelscape.operators import binned
from labelscape.operators import nearest as nn


def pivot(df):
    return df.toPandas().pivot(index="source", columns="target", values="value")


def test_centroid_distances(spark):
    spots = spark.createDataFrame([(1, 0.0, 0.0), (2, 2.0, 0.0), (3, 4.0, 0.0)], "cell_id long, x double, y double")
    expr = spark.createDataFrame([(1, "g1", 1.0), (2, "g1", 1.0), (3, "g2", 3.0)], "cell_id long, gene string, value double")
    got = pivot(binned.wmda(expr, spots))
    assert got.loc["g1"].tolist() == [1, 3] and got.loc["g2"].tolist() == [3, 0]
    assert pivot(binned.wmda(expr, spots, broadcast_rows=1)).equals(got)


def test_centroid_distances_both_ways(spark, monkeypatch):
    for name, value in (("CENTRE_CHUNK", 2), ("SPOT_BLOCK", 25), ("SLICE", 8)):
        monkeypatch.setattr(binned, name, value)
    monkeypatch.setattr(binned, "CELLS", 12)
    rng = np.random.default_rng(1)
    spots = spark.createDataFrame([(i, *map(float, rng.uniform(0, 9, 2))) for i in range(60)], "cell_id long, x double, y double")
    rows = [(i, f"g{g}", float(rng.uniform(0.1, 4))) for i in range(60) for g in range(7) if rng.random() < (0.9 if g == 0 else 0.2)]
    expr = spark.createDataFrame(rows, "cell_id long, gene string, value double")
    one, other = pivot(binned.wmda(expr, spots)), pivot(binned.wmda(expr, spots, broadcast_rows=1))
    assert one.shape == (7, 7) and np.allclose(one, other)
    frame = expr.toPandas().merge(spots.toPandas(), on="cell_id")
    centre = frame.groupby("gene").apply(lambda g: pd.Series({c: np.average(g[c], weights=g["value"]) for c in "xy"}))
    for name, part in frame.groupby("gene"):
        for target, place in centre.iterrows():
            want = np.average(np.hypot(part["x"] - place["x"], part["y"] - place["y"]), weights=part["value"])
            assert one.loc[name, target] == pytest.approx(want)


def test_shared_spots_cost_almost_nothing(spark):
    spots = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0)], "cell_id long, x double, y double")
    expr = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "c", 4.0)], "cell_id long, gene string, value double")
    got = pivot(binned.ewnn(expr, spots))
    assert got.loc["a", "b"] == got.loc["b", "a"] == got.loc["c", "c"] == 1e-8
    assert got.loc["a", "c"] == pytest.approx(5 / 2) and got.loc["b", "c"] == pytest.approx(5 / (2**0.5 * 2))
    with pytest.raises(ValueError):
        binned.ewnn(expr, spots, threshold=-1)


@pytest.mark.parametrize("strategy", ["broadcast", "packed"])
def test_cheapest_pairs_by_loops(spark, strategy):
    rng = np.random.default_rng(3)
    xy = np.round(rng.uniform(0, 9, (1500, 2)), 1)
    rows = [(i, f"g{g}", float(rng.uniform(0.1, 40))) for i in range(1500) for g in range(3) if rng.random() < (0.9, 0.8, 0.01)[g]]
    spots = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xy)], "cell_id long, x double, y double")
    expr = spark.createDataFrame([*rows, (0, None, 2.0)], "cell_id long, gene string, value double")
    got = {(r.source, r.target): r.value for r in binned.ewnn(expr, spots, strategy=strategy).collect() if r.source is not None}
    for a in ("g0", "g1", "g2"):
        for b in ("g0", "g1", "g2"):
            one, two = (np.array([[*xy[i], v] for i, g, v in rows if g == name]) for name in (a, b))
            cost = np.hypot(*(one[:, None, :2] - two[None, :, :2]).transpose(2, 0, 1)) / np.sqrt(one[:, None, 2] * two[None, :, 2])
            assert got[a, b] == pytest.approx(cost.min() + 1e-8, rel=1e-12)
    assert len(got) == 9


def test_the_cost_kernel_gives_one_row_a_pair(spark):
    rng = np.random.default_rng(4)
    points = [(f"g{i % 3}", *map(float, rng.uniform(0, 9, 2)), float(rng.uniform(0.1, 2))) for i in range(3000)]
    df = spark.createDataFrame(points, "source string, x double, y double, scale double")
    got = nn.cheapest(df, df.withColumnRenamed("source", "gene"), ["x", "y"], "gene", factor="scale")
    assert got.count() <= 9 * 8 and got.select("source", "target").distinct().count() == 9


def sparse_case(spark):
    rng = np.random.default_rng(2)
    xy = rng.uniform(0, 10, (60, 2))
    expr = {g: np.where(rng.random(60) < p, rng.integers(1, 9, 60), 0) for g, p in (("a", 0.6), ("b", 0.5), ("s", 0.05))}
    expr["s"][:2] = 3
    spots = spark.createDataFrame(pd.DataFrame(xy, columns=["x", "y"]).assign(cell_id=range(60)))
    rows = [(i, g, float(v)) for g, vs in expr.items() for i, v in enumerate(vs) if v]
    return xy, expr, spots, spark.createDataFrame(rows, "cell_id long, gene string, value double")


def test_sparse_genes_are_marked(spark):
    _, _, spots, expr = sparse_case(spark)
    directed = pivot(binned.visium(expr, spots, min_spots=20, symmetric="none"))
    assert directed.loc["s"].isna().all() and directed.loc["a", "s"] == np.inf and directed.loc["a", "a"] == 0
    both = pivot(binned.visium(expr, spots, min_spots=20))
    assert both.loc["s", "s"] == 0 and both.loc["a", "s"] == both.loc["s", "a"] == np.inf
    assert both.loc["a", "b"] == both.loc["b", "a"] == min(directed.loc["a", "b"], directed.loc["b", "a"])


def test_directed_value_by_loops(spark):
    xy, expr, spots, df = sparse_case(spark)
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    own, other = expr["a"] > 0, expr["b"] > 0
    near, weight = d[np.ix_(own, other)].min(axis=1), expr["a"][own]
    lone = d.copy()
    np.fill_diagonal(lone, np.inf)
    unit = np.median(lone.min(axis=1))
    order = np.argsort(near)
    at = np.searchsorted(np.cumsum(weight[order]) / weight.sum(), 0.9)
    want = {"quantile": near[order][at], "mean": np.average(near, weights=weight)}
    for agg, value in want.items():
        got = pivot(binned.visium(df, spots, min_spots=5, agg=agg, symmetric="none"))
        assert got.loc["a", "b"] == pytest.approx(value / unit)
    assert pivot(binned.weighted_nearest(df, spots)).loc["a", "b"] == pytest.approx(want["mean"])
    with pytest.raises(ValueError):
        binned.visium(df, spots, symmetric="max")
