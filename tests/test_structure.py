"""Label matrices, clustering and structure maps on hand-made inputs."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from labelscape import api
from labelscape.functions import linkage as link
from labelscape.operators import matrices as mx
from labelscape.operators import structure as st
from labelscape.operators.neighbors import split_by_distance
from labelscape.operators.samples import two_sided
from tests import brute


def square(df, row="row", col="col"):
    return df.toPandas().pivot(index=row, columns=col, values="value").sort_index().sort_index(axis=1)


def points(spark, rows, columns="x double, y double, celltype string"):
    return spark.createDataFrame(rows, columns)


def test_matrix_is_directed_with_zero_diagonal(spark):
    got = square(mx.searcher_findee(points(spark, [(0.0, 0.0, "A"), (2.0, 0.0, "A"), (5.0, 0.0, "B")])), "source", "target")
    assert got.loc["A", "B"] == 4 and got.loc["B", "A"] == 3 and got.loc["A", "A"] == got.loc["B", "B"] == 0


def test_rows_are_vectors_not_distances(spark):
    df = points(spark, [(0.0, 0.0, "A"), (1.0, 0.0, "B"), (5.0, 0.0, "C")])
    rows, cols = api.compute_cophenetic_distances_from_df(df)
    got = square(rows)
    high = (math.sqrt(59) + math.sqrt(48)) / 2
    assert got.loc["A", "B"] == pytest.approx(math.sqrt(3) / high)
    assert got.loc["A", "C"] == got.loc["B", "C"] == 1 and got.loc["A", "A"] == 0
    assert len(cols.collect()) == 9


def test_single_label(spark):
    matrix = points(spark, [("A", "A", 0.0)], "source string, target string, value double")
    with pytest.raises(Exception, match="two labels"):
        st.structure_map(matrix).collect()
    assert st.structure_map(matrix, single="zero").collect()[0].value == 0


def test_unit_weights_change_nothing_and_weights_only_average(spark):
    rng = np.random.default_rng(3)
    xy, labels = rng.uniform(0, 9, (60, 2)), rng.choice(list("pqr"), 60)
    weights = rng.uniform(0.5, 4, 60)
    df = spark.createDataFrame(pd.DataFrame({"x": xy[:, 0], "y": xy[:, 1], "celltype": labels, "weight": weights, "one": 1.0}))
    plain = square(mx.searcher_findee(df), "source", "target")
    unit = square(mx.weighted_searcher_findee(df, weight_col="one"), "source", "target")
    assert np.allclose(plain, unit)
    got = square(mx.weighted_searcher_findee(df), "source", "target")
    assert np.allclose(got, brute.label_matrix(xy, labels, weights)[1])


def test_negative_weights_shift_the_frame(spark):
    df = points(spark, [(0.0, 0.0, "A", -2.0), (1.0, 0.0, "A", 0.0), (4.0, 0.0, "B", 1.0)], "x double, y double, celltype string, weight double")
    got = square(mx.weighted_searcher_findee(df), "source", "target")
    # the first point's weight becomes 0 and drops it from sources and targets
    assert got.loc["A", "B"] == 3 and got.loc["B", "A"] == 3


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="celltype"):
        mx.searcher_findee(points(spark, [(0.0, 0.0, "A")], "x double, y double, other string"))


@settings(max_examples=40, deadline=None)
@given(hs.integers(3, 14), hs.integers(0, 10**6))
def test_average_map_matches_member_pairs(n, seed):
    rows = np.random.default_rng(seed).uniform(0, 5, (n, n))
    got = link.structure_map(rows, "average")
    assert np.allclose(got, brute.average_map(rows))
    assert np.allclose(got, got.T) and (np.diag(got) == 0).all() and got.max() == 1
    for i in range(n):
        assert (got <= np.maximum(got[i][:, None], got[i][None, :]) + 1e-12).all()


@settings(max_examples=30, deadline=None)
@given(hs.integers(3, 10), hs.integers(0, 10**6), hs.sampled_from(link.METHODS))
def test_label_order_does_not_matter(n, seed, method):
    rng = np.random.default_rng(seed)
    rows, order = rng.uniform(0, 5, (n, 4)), rng.permutation(n)
    assert np.allclose(link.structure_map(rows, method)[np.ix_(order, order)], link.structure_map(rows[order], method))


def test_two_point_heights():
    distances = link.row_distances(np.array([[0.0], [3.0], [10.0]]))
    heights = {m: link.linkage(distances, m)[-1, 2] for m in link.METHODS}
    assert heights["single"] == 7 and heights["complete"] == 10
    assert heights["average"] == heights["weighted"] == 8.5
    assert heights["centroid"] == heights["median"] == pytest.approx(8.5)
    assert heights["ward"] == pytest.approx(math.sqrt(2 * 2 / 3) * 8.5)


def test_unknown_choices(spark):
    matrix = points(spark, [("A", "A", 0.0)], "source string, target string, value double")
    with pytest.raises(ValueError, match="method"):
        st.structure_map(matrix, method="nope")
    with pytest.raises(ValueError, match="metric"):
        st.cophenetic_from_mean_matrix(matrix, metric="nope")
    with pytest.raises(TypeError):
        st.cophenetic_from_mean_matrix([[0.0]])


def test_mean_matrix_fills_gaps_and_handles_constants(spark):
    flat = points(spark, [(a, b, 2.0) for a in "AB" for b in "AB"], "source string, target string, value double")
    assert (square(st.cophenetic_from_mean_matrix(flat)) == 0).all().all()
    gaps = points(spark, [("A", "A", 0.0), ("A", "B", None), ("B", "A", 2.0), ("B", "B", 4.0)], "source string, target string, value double")
    filled = {(r.source, r.target): r.value for r in st.fill_missing(gaps).collect()}
    assert filled["A", "B"] == 4.0


def test_dendrogram_scores_halve_per_level(spark):
    df = points(spark, [(0.0, 0.0, "A"), (1.0, 0.0, "B"), (5.0, 0.0, "C")])
    tree = api.compute_col_dendrogram_scores(df)
    assert tree["score"] is None and tree["left"]["score"] == tree["right"]["score"] == 1.0
    inner = tree["left"] if "left" in tree["left"] else tree["right"]
    assert inner["left"]["score"] == 0.5 and {inner["left"]["name"], inner["right"]["name"]} == {"A", "B"}


def test_newick_text(spark):
    df = points(spark, [(0.0, 0.0, "A"), (1.0, 0.0, "B"), (5.0, 0.0, "C")])
    text = st.newick(mx.searcher_findee(df)).first()["newick"]
    low, high = math.sqrt(3), (math.sqrt(59) + math.sqrt(48)) / 2
    assert text == f"(C:{high:.6f},(A:{low:.6f},B:{low:.6f}):{high - low:.6f}):0.000000;"


def test_leaves_of_a_subtree_stay_together(spark):
    df = points(spark, [(0.0, 0.0, "A"), (9.0, 0.0, "B"), (0.5, 0.0, "C"), (9.5, 0.0, "D")])
    order = {r.label: r.position for r in st.leaf_positions(mx.searcher_findee(df)).collect()}
    assert abs(order["A"] - order["C"]) == abs(order["B"] - order["D"]) == 1


def test_split_ties_go_far(spark):
    df = points(spark, [(0.0, 0.0, "A"), (1.0, 0.0, "B"), (2.0, 0.0, "B"), (3.0, 0.0, "B")])
    got = {r.x: r[-1] for r in split_by_distance(df, "A", "B").select("x", "split_B_by_A_in_celltype").collect()}
    assert got == {0.0: "A", 1.0: "B_close", 2.0: "B_far", 3.0: "B_far"}
    with pytest.raises(ValueError, match="Z"):
        split_by_distance(df, "Z", "B")


def test_finite_block_drops_rows_then_columns(spark):
    rows = [("A", "A", 0.0), ("A", "B", float("inf")), ("B", "A", 1.0), ("B", "B", 0.0), ("C", "A", 2.0), ("C", "B", 3.0)]
    got = mx.finite_block(points(spark, rows, "source string, target string, value double"), dropna_axis="none")
    assert {(r.source, r.target) for r in got.collect()} == {("B", "A"), ("B", "B"), ("C", "A"), ("C", "B")}


def test_strict_mean_over_samples(spark):
    rows = [(1, "A", "B", 2.0), (2, "A", "B", 4.0), (1, "A", "C", 7.0)]
    df = points(spark, rows, "sample int, source string, target string, value double")
    assert {r.target: r.value for r in mx.mean_matrix(df, "sample").collect()} == {"B": 3.0, "C": None}
    assert {r.target: r.value for r in mx.mean_matrix(df, "sample", strict=False).collect()} == {"B": 3.0, "C": 7.0}


def test_drift_on_the_union_of_labels(spark):
    kinds = "source string, target string, value double"
    before = points(spark, [("A", "B", 0.2), ("B", "A", 0.4), ("A", "A", 5.0)], kinds)
    after = points(spark, [("A", "B", 0.5), ("C", "A", 0.3)], kinds)
    delta, score = mx.drift(before, after)
    want = {("A", "B"): 0.3, ("B", "A"): 0.6, ("C", "A"): -0.7}
    got = {(r.source, r.target): r.delta for r in delta.collect()}
    assert len(got) == 9 and all(got[k] == pytest.approx(want.get(k, 0.0)) for k in got)
    assert {r.source: r.mean_abs_delta for r in score.collect()} == pytest.approx({"A": 0.1, "B": 0.2, "C": 0.7 / 3})


def test_stage_means(spark):
    rows = [("s", "A", "B", 0.2), ("s", "A", "B", 0.4), ("t", "C", "A", 0.5)]
    got = mx.stage_mean(points(spark, rows, "stage string, source string, target string, value double"), "stage")
    values = {(r.stage, r.source, r.target): r.value for r in got.collect()}
    assert len(values) == 18 and values["s", "A", "B"] == pytest.approx(0.3) and values["t", "C", "A"] == 0.5
    assert values["t", "A", "B"] == 1 and values["s", "B", "B"] == 0


def test_normal_tails(spark):
    values = [0.0, 1e-9, 0.3, 1.0, 1.9999, 2.0, 2.0001, 3.0, 6.0, 8.0, 8.6, 12.0, 25.0, 37.0, 60.0]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "z double").select("z", two_sided(F.col("z")).alias("p")).collect()
    for r in rows:
        assert r.p == (None if r.z is None else pytest.approx(math.erfc(r.z / math.sqrt(2)), rel=1e-11, abs=1e-320))
