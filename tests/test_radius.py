import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelscape.operators.neighbors import neighbor_edges, radius_edges
from labelscape.operators.radius import _Chunks, _largest_square, _reached, counts_within, pairs_within


def brute(rows, radius):
    return {(a[0], b[0]): ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 for a in rows for b in rows
            if a[0] != b[0] and ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 <= radius}


def frame(spark, rows):
    return spark.createDataFrame(rows, "cell_id long, x double, y double").repartition(5)


@pytest.mark.parametrize("radius,block", [(0.02, 16), (0.2, 4), (5.0, 256)])
def test_pairs_equal_brute_force(spark, radius, block):
    rng = random.Random(7)
    rows = [(i, rng.random() ** 3, rng.random()) for i in range(300)] + [(1000 + i, 0.5, 0.5) for i in range(30)] + [(2000, -40.0, 99.0)]
    more = [(3000, None, 0.1), (3001, 0.1, float("nan")), (None, 0.5, 0.5)]
    got = pairs_within(frame(spark, rows + more), ["x", "y"], "cell_id", radius, block=block).collect()
    want = brute(rows, radius)
    assert {(r["cell_id"], r["neighbor"]): r["dist"] for r in got} == pytest.approx(want) and len(got) == len(want)


def test_exactly_the_radius_counts(spark):
    rows = [(i, 0.25 * i, 0.0) for i in range(20)]
    assert {(r["cell_id"], r["neighbor"]) for r in radius_edges(frame(spark, rows), 0.25).collect()} == set(brute(rows, 0.25))


def test_one_dense_spot_is_many_tasks(spark):
    rng = random.Random(8)
    rows = [(i, rng.random() * 1e-3, rng.random() * 1e-3) for i in range(3000)]  # all in one square of the radius
    found = pairs_within(frame(spark, rows), ["x", "y"], "cell_id", 1e-4)
    parts = [n for n in found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(parts) >= 6 and max(parts) < 0.4 * sum(parts)
    assert sum(parts) == found.count() > 3000


def test_text_ids_and_no_rows(spark):
    points = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.0, 1.0), ("c", 9.0, 0.0)], "cell_id string, x double, y double")
    assert {tuple(r) for r in neighbor_edges(points, radius=1.0).collect()} == {("a", "b"), ("b", "a")}
    assert radius_edges(points.where("x > 99"), 1.0).count() == 0
    with pytest.raises(ValueError):
        radius_edges(points, 0.0)


@pytest.mark.parametrize("labels,radius", [(3, 0.25), (150, 0.25), (150, 1.5)])
def test_counts_equal_listed_pairs(spark, labels, radius):
    rng = random.Random(11)
    rows = [(i, rng.randrange(64) / 16, rng.randrange(5) / 4, str(rng.randrange(labels))) for i in range(1500)]
    rows += [(2000 + i, 1.0, 0.5, str(rng.randrange(labels))) for i in range(300)] + [(9000, -40.0, 99.0, "far")]
    points = spark.createDataFrame(rows, "cell_id long, x double, y double, celltype string").repartition(5)
    of, want, degrees = {r[0]: r[3] for r in rows}, {}, dict.fromkeys((r[0] for r in rows), 0)
    for a, b in brute([r[:3] for r in rows], radius):
        want[of[a], of[b]] = want.get((of[a], of[b]), 0) + 1
        degrees[a] += 1
    counts, whole = counts_within(points, ["x", "y"], "celltype", [radius, 0.01])
    got = {(r["source"], r["target"]): r["edges"] for r in counts.where(f"radius = {radius}").collect()}
    assert got == want
    total = whole.where(f"radius = {radius}").first()
    assert (total["edges"], total["squares"]) == (sum(want.values()), sum(n * n for n in degrees.values()))


def test_counting_measures_only_where_the_radius_ends(monkeypatch):
    """Pairs of blocks of 256 that the radius cuts were measured whole, here 180 of 256 pairs."""
    n, radius = 4096, 0.5
    side = np.stack(np.meshgrid(np.arange(64), np.arange(64), indexing="ij"), axis=-1).reshape(8, 8, 8, 8, 2).transpose(0, 2, 1, 3, 4).reshape(n, 2) / 64
    points = _Chunks(np.arange(n) // 64, side, np.arange(n) % 2, np.ones(n))
    measured, root = [], np.sqrt
    monkeypatch.setattr(np, "sqrt", lambda x, **more: measured.append(np.size(x)) or root(x, **more))
    near, far = points.boxes_apart(points)
    got = points.by_label(_reached(points, near, far, points, points.parted(), radius))
    monkeypatch.undo()
    reached = ((side[:, None] - side[None]) ** 2).sum(axis=-1) <= radius * radius
    assert got.tolist() == [[reached[a::2, b::2].sum() for b in range(2)] for a in range(2)]
    assert sum(measured) < n * n / 3


def test_pairs_are_made_without_python_and_given_out_as_they_come(spark):
    """Pairs came from Python, 24 bytes a pair; joined in one compiled loop, a group's pairs with a block would all be held."""
    rng = random.Random(12)
    rows = [(i, rng.random(), rng.random()) for i in range(600)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = radius_edges(frame(spark, rows), 0.1)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "InArrow" not in plan and "InPandas" not in plan
    above = plan[:plan.index("SortMergeJoin")]
    assert above.count("Generate inline") == 2 and not above.rstrip(" :+-").endswith(")")  # "*(n)" marks what is compiled
    assert {(r["cell_id"], r["neighbor"]): r["dist"] for r in found.collect()} == pytest.approx(brute(rows, 0.1))


@pytest.mark.parametrize("kind", ["double", "string"])
def test_pairs_in_space_with_ids_that_come_twice(spark, kind):
    rng = random.Random(13)
    rows = [(float(i % 350), *(rng.randrange(12) / 8 for _ in range(3))) for i in range(400)]
    want = sorted((a[0], b[0], math.sqrt(sum((p - q) ** 2 for p, q in zip(a[1:], b[1:])))) for a in rows for b in rows if a[0] != b[0])
    points = spark.createDataFrame(rows, "cell_id double, x double, y double, z double").withColumn("cell_id", F.col("cell_id").cast(kind))
    got = pairs_within(points, ["x", "y", "z"], "cell_id", 0.25, block=64).collect()
    assert sorted((float(a), float(b), d) for a, b, d in got) == [r for r in want if r[2] <= 0.25]


@pytest.mark.parametrize("radius", [0.25, 0.1, 1.0, 3, 1e-4, 1 / 3, 1e-160, 1e-200, 1e200, math.inf])
def test_squares_are_cut_where_roots_are(radius):
    last = _largest_square(radius)
    assert math.sqrt(last) <= radius and (last >= 1.7e308 or math.sqrt(math.nextafter(last, math.inf)) > radius)
