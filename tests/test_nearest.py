"""Both search plans against brute force, with skew: hot labels, copies, outliers, dense spots."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelscape.operators import nearest as nn
from labelscape.operators import spreading
from labelscape.operators.neighbors import neighbor_edges, radius_edges, smooth
from labelscape.operators.samples import sample_matrices
from tests import brute


def cloud(n=900, dims=2, seed=0):
    """A third of the points are copies of one place, a third one dense spot, the rest spread; one far label."""
    rng = np.random.default_rng(seed)
    xyz = rng.uniform(-50, 50, (n, dims))
    xyz[: n // 3] = 7.25
    xyz[n // 3: 2 * n // 3] = 3 + rng.normal(0, 1e-4, (2 * n // 3 - n // 3, dims))
    labels = rng.choice(["a", "b", "c", "d"], n, p=[0.7, 0.2, 0.07, 0.03])
    xyz[-2:], labels[-2:] = 5000.0, "far"
    return xyz, labels


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(nn, "SOURCE_BLOCK", 16)
    monkeypatch.setattr(nn, "TARGET_BLOCK", 8)
    monkeypatch.setattr(nn, "GROUP_BITS", 2)
    monkeypatch.setattr(nn, "FOLD_ROWS", 20)


def frame(spark, xyz, labels):
    axes = ["x", "y", "z"][: xyz.shape[1]]
    return spark.createDataFrame(pd.DataFrame(xyz, columns=axes).assign(id=range(len(xyz)), label=labels)), axes


@pytest.mark.parametrize("dims", [2, 3])
@pytest.mark.parametrize("strategy", ["broadcast", "packed"])
def test_nearest_per_label_is_exact(spark, small_blocks, dims, strategy):
    xyz, labels = cloud(dims=dims)
    df, axes = frame(spark, xyz, labels)
    got = nn.nearest_per_label(df, df, axes, "label", strategy=strategy).toPandas()
    want = brute.nearest(xyz, xyz, labels)
    assert len(got) == len(want)
    assert max(abs(want[i, t] - d) for i, t, d in zip(got.id, got.target, got.dist)) < 1e-9


@pytest.mark.parametrize("strategy", ["broadcast", "packed"])
def test_target_factors_scale_distances(spark, small_blocks, strategy):
    xyz, labels = cloud(400)
    factor = np.random.default_rng(1).uniform(0.1, 9, len(xyz))
    df, axes = frame(spark, xyz, labels)
    df = df.join(spark.createDataFrame(pd.DataFrame({"id": range(len(xyz)), "f": factor})), "id")
    got = nn.nearest_per_label(df, df, axes, "label", factor="f", strategy=strategy).toPandas()
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1)) * factor[None, :]
    assert max(abs(d[i, labels == t].min() - v) for i, t, v in zip(got.id, got.target, got.dist)) < 1e-9


@pytest.mark.parametrize("strategy", ["broadcast", "packed"])
def test_k_nearest_with_copies(spark, small_blocks, strategy):
    xyz, labels = cloud(300)
    df, axes = frame(spark, xyz, labels)
    got = nn.k_nearest(df, axes, "id", 5, strategy=strategy).toPandas()
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :5]
    for i, rows in got.sort_values("rank").groupby("id"):
        assert list(rows.neighbor) == list(want[i])


def test_fewer_points_than_k(spark):
    df, axes = frame(spark, np.array([[0.0, 0], [1, 0], [5, 0]]), np.array(["a", "a", "a"]))
    got = neighbor_edges(df.withColumnRenamed("id", "cell_id"), k_neighbors=8).toPandas()
    assert sorted(zip(got.cell_id, got.neighbor)) == [(i, j) for i in range(3) for j in range(3) if i != j]


@pytest.mark.parametrize("strategy", ["broadcast", "packed"])
def test_samples_never_meet(spark, small_blocks, strategy):
    xyz, labels = cloud(600)
    samples = np.arange(600) % 3
    df, _ = frame(spark, xyz, labels)
    df = df.withColumn("sample", F.col("id") % 3)
    got = sample_matrices(df, "sample", celltype_col="label", strategy=strategy).toPandas()
    count = 0
    for s in range(3):
        names, want = brute.label_matrix(xyz[samples == s], labels[samples == s])
        for i, a in enumerate(names):
            for j, b in enumerate(names):
                row = got[(got["sample"] == s) & (got.source == a) & (got.target == b)]
                assert abs(row.value.iloc[0] - want[i, j]) < 1e-9
                count += 1
    assert count == len(got)


def test_missing_labels_and_coordinates_are_ignored(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, "a"), (2, 1.0, 0.0, None), (3, None, 0.0, "b"), (4, 3.0, 0.0, "b")],
                               "id long, x double, y double, label string")
    got = nn.nearest_per_label(df.where("label is not null"), df, ["x", "y"], "label").toPandas()
    assert {(r.id, r.target): r.dist for r in got.itertuples()} == {
        (1, "a"): 0, (1, "b"): 3, (4, "a"): 3, (4, "b"): 0}


def test_beyond_its_bound_broadcast_gives_way(spark):
    df, axes = frame(spark, *cloud(60))
    assert nn.nearest_per_label(df, df, axes, "label", strategy="broadcast", broadcast_rows=5).count() == 60 * df.select("label").distinct().count()
    few = {tuple(r) for r in nn.k_nearest(df, axes, "id", 2, strategy="broadcast", broadcast_rows=5).collect()}
    assert few == {tuple(r) for r in nn.k_nearest(df, axes, "id", 2).collect()} and len(few) == 120


def test_radius_is_inclusive_and_skips_self(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 1.0, 0.0), (4, 2.5, 0.0)], "cell_id long, x double, y double")
    got = {(r.cell_id, r.neighbor) for r in radius_edges(df, 1.0).collect()}
    assert got == {(1, 2), (2, 1), (1, 3), (3, 1), (2, 3), (3, 2)}
    # just so far apart, although rounding puts the points near the edges of cells of that side
    edge = spark.createDataFrame([(1, 0.24999999999999997, 0.0), (2, 0.5, 0.0)], "cell_id long, x double, y double")
    assert {(r.cell_id, r.neighbor) for r in radius_edges(edge, 0.25).collect()} == {(1, 2), (2, 1)}


def test_smoothing_counts_absent_values_as_zero(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1)], "cell_id long, neighbor long")
    values = spark.createDataFrame([(1, "g", 4.0), (3, "g", 5.0)], "cell_id long, gene string, value double")
    got = {r.cell_id: r.value for r in smooth(values, edges).collect()}
    assert got == {1: 2.0, 2: 2.0, 3: 5.0}


def test_vector_sums_by_loops(spark, monkeypatch):
    monkeypatch.setattr(spreading, "BLOCK", 16)
    monkeypatch.setattr(spreading, "ENTRIES", 37)
    rng = np.random.default_rng(5)
    entries = [(f"p{i}", f"g{g}", float(rng.integers(1, 9)), 1) for i in range(80) for g in range(12) if rng.random() < 0.4 and i % 9]
    links = [(f"p{rng.integers(90)}", int(i), "ab"[i % 2]) for i in range(100) for _ in range(rng.integers(0, 9))] + [("p1", i, "a") for i in range(100)]
    rows = spark.createDataFrame(entries, "source string, gene string, v long, one int".replace("v long", "v double"))
    edges = spark.createDataFrame(links, "source string, id long, kind string")
    places = spark.createDataFrame([(i, float(rng.random()), float(rng.random())) for i in range(95)], "id long, x double, y double")
    want = {}
    for source, i, kind in links:
        for _, gene, v, one in (e for e in entries if e[0] == source):
            a, b = want.get((i, kind, gene), (0.0, 0.0))
            want[i, kind, gene] = (a + v, b + one)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
    try:
        for few, where in ((1000, None), (0, None), (0, places)):
            monkeypatch.setattr(spreading, "FEW_EDGES", few)
            got = spreading.vector_sums(rows, edges, source="source", keys=["id", "kind"], column="gene", values=["v", "one"], places=where).collect()
            assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == want and len(got) == len(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_product_sums_by_loops(spark, monkeypatch):
    monkeypatch.setattr(spreading, "BLOCK", 16)
    monkeypatch.setattr(spreading, "ENTRIES", 37)
    rng = np.random.default_rng(6)
    entries = [(f"p{i}", f"g{g}", float(rng.integers(1, 9)), 1.0) for i in range(80) for g in range(12) if rng.random() < 0.4 and i % 9]
    # g3 meets under three names, g11 under none; some points have no partners and some no edges
    named = [("u", 0), ("u", 1), ("w", 2), ("u", 3), ("v", 3), ("w", 3), *[(f"n{g}", g) for g in range(4, 11)]]
    meets = [(i, n, f"g{g}", float(rng.integers(1, 9)), float(rng.integers(2))) for i in range(0, 110) for n, g in named if rng.random() < 0.5 and i % 7]
    links = [(f"p{rng.integers(90)}", int(i), "ab"[i % 2], "xyz"[i % 3]) for i in range(100) for _ in range(rng.integers(0, 9))]
    links += [("p1", i, "a", "x") for i in range(100)]
    rows = spark.createDataFrame(entries, "source string, gene string, v double, one double")
    partners = spark.createDataFrame(meets, "id int, name string, gene string, v double, one double")
    edges = spark.createDataFrame(links, "source string, id long, kind string, type string")
    places = spark.createDataFrame([(i, float(rng.random()), float(rng.random())) for i in range(95)], "id long, x double, y double")
    want = {}
    for source, i, kind, other in links:
        for _, gene, v, one in (e for e in entries if e[0] == source):
            for _, name, _, w, two in (m for m in meets if m[0] == i and m[2] == gene):
                a, b = want.get((name, kind, other), (0.0, 0.0))
                want[name, kind, other] = (a + v * w, b + one * two)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
    try:
        for few, where in ((10000, None), (0, None), (0, places)):
            monkeypatch.setattr(spreading, "FEW_EDGES", few)
            got = spreading.product_sums(rows, partners, edges, source="source", keys=["id", "kind", "type"], column="gene", values=["v", "one"],
                                         name="name", places=where).collect()
            assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == want and len(got) == len(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("strategy", ["broadcast", "packed"])
def test_sums_equal_the_rows_added_up(spark, strategy):
    df, axes = frame(spark, *cloud(300))
    sources = df.select(F.col("label").alias("source"), (F.col("id") % 3).alias("part"), *axes).groupBy("source", "part", *axes).agg(
        F.count("*").alias("n"), F.sum(F.lit(0.5)).alias("w"))
    targets = df.withColumn("part", F.col("id") % 3)
    for by in (None, "part"):
        keys = [*([by] if by else []), "source", "target"]
        rows = nn.nearest_per_label(sources, targets, axes, "label", by=by, strategy=strategy).groupBy(*keys).agg(
            F.sum("n"), F.sum(F.col("dist") * F.col("n")), F.sum("w"), F.sum(F.col("dist") * F.col("w"))).collect()
        some = nn.nearest_sums(sources, targets, axes, "label", by=by, strategy=strategy)
        sums = some.groupBy(*keys).agg(*[F.sum(c) for c in ("n", "nd", "w", "wd")]).collect()
        k = len(keys)
        got = {tuple(r)[:k]: tuple(r)[k:] for r in sums}
        assert len(got) == len(rows) and all(got[tuple(r)[:k]] == pytest.approx(tuple(r)[k:]) for r in rows)


def test_a_batch_of_sources_gives_a_row_for_each_pair_of_labels(spark):
    df, axes = frame(spark, *cloud(400))
    labels = df.select("label").distinct().count()
    sources = df.select(F.col("label").alias("source"), *axes, F.lit(1).alias("n"), F.lit(1.0).alias("w")).repartition(2)
    rows = nn.nearest_sums(sources, df, axes, "label", strategy="broadcast").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in rows) <= labels * labels


def test_many_copies_of_a_place_are_few_targets(spark):
    """4,000 points at five places: of each place the lowest ids are met, and no task holds all pairs of copies."""
    import tracemalloc
    from labelscape.functions import geometry as geo
    rows = [(i, float(i % 5), float(i % 5 % 2)) for i in range(4000)]
    points = spark.createDataFrame(rows, "cell_id long, x double, y double").repartition(4)
    for strategy in ("broadcast", "packed"):
        got = {}
        for r in nn.k_nearest(points, ["x", "y"], "cell_id", 3, strategy=strategy).collect():
            got.setdefault(r["cell_id"], []).append((r["rank"], r["neighbor"], r["dist"]))
        assert len(got) == 4000
        for i, found in got.items():
            others = [j for j in range(i % 5, 40, 5) if j != i][:3]
            assert sorted(found) == [(n + 1, j, 0.0) for n, j in enumerate(others)]
    # a run of sources at two far places meets the points between them a part at a time
    rng = np.random.default_rng(1)
    cloud = geo.TargetCloud(rng.random((60_000, 2)), ids=np.arange(60_000))
    source = np.concatenate([np.full((64, 2), 0.01), np.full((64, 2), 0.99)])
    best, ids = np.full((128, 4), np.inf), np.zeros((128, 4), np.int64)
    tracemalloc.start()
    geo.merge_k_nearest(source, np.full(128, -1), np.array([0]), source.min(axis=0)[None], source.max(axis=0)[None], cloud, best, ids)
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()
    for row in (0, 127):
        far = np.sqrt(((cloud.coords - source[row]) ** 2).sum(axis=1))
        assert set(ids[row]) == set(cloud.ids[np.argsort(far)[:4]])


def test_smoothing_makes_its_values_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(i):
        made.add(1)
        return float(i)

    points = spark.range(40).select(F.col("id").alias("cell_id"), F.lit("g").alias("gene"), (F.col("id") + 1).alias("_i"))
    edges = spark.range(39).select(F.col("id").alias("cell_id"), (F.col("id") + 1).alias("neighbor"))
    found = {r["cell_id"]: r["value"] for r in smooth(points.select("cell_id", "gene", value("_i").alias("value")), edges).collect()}
    assert found == {i: i + 1.5 if i < 39 else 40.0 for i in range(40)}
    assert made.value == 40
