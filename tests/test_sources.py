"""Loaders on small files, sinks, figures' data steps and streaming sums."""

import gzip
import math

import pytest
from pyspark.sql import functions as F

from labelscape.operators import samples, synthetic
from labelscape.operators.matrices import searcher_findee
from labelscape.render import figures
from labelscape.sources import bundles, files, points
from labelscape.sources.sinks import write_matrix_csv, write_table
from labelscape.streaming.accumulate import accumulate, accumulated


def bundle(spark, folder):
    cells = spark.createDataFrame([("c1", 0.0, 0.0), ("c2", 1.0, 1.0)], "cell_id string, x_centroid double, y_centroid double")
    cells.toPandas().to_parquet(folder / "cells.parquet")
    (folder / "sample_cell_groups.csv").write_text("Barcode,Clusters\nc1,A\nc2,B\n")
    matrix = folder / "cell_feature_matrix"
    matrix.mkdir()
    (matrix / "barcodes.tsv").write_text("c1\nc2\n")
    (matrix / "features.tsv").write_text("id1\tG1\tGene Expression\nid2\tG2\tGene Expression\n")
    with gzip.open(matrix / "matrix.mtx.gz", "wt") as f:
        f.write("%%MatrixMarket matrix coordinate integer general\n%\n2 2 3\n1 1 5\n2 1 1\n2 2 7\n")
    return folder


def test_table_bundle(spark, tmp_path):
    got = bundles.load_table_bundle(spark, str(bundle(spark, tmp_path)))
    assert {r.cell_id: (r.x, r.Cluster, r.Clusters) for r in got.cells.collect()} == {"c1": (0, "A", "A"), "c2": (1, "B", "B")}
    assert {(r.cell_id, r.gene): r.value for r in got.expression.collect()} == {("c1", "G1"): 5, ("c1", "G2"): 1, ("c2", "G2"): 7}
    scaled = bundles.load_cells(spark, str(tmp_path))
    assert scaled.expression.count() == 4 and scaled.raw.count() == 3
    few = bundles.load_cells(spark, str(tmp_path), sparse=True)
    assert few.expression.count() == 3 and few.filled.rest.count() == 2
    want = {(r.cell_id, r.gene): r.value for r in scaled.expression.collect()}
    assert {(r.cell_id, r.gene): r.value for r in few.filled.dense(few.cells, few.genes).collect()} == want
    (tmp_path / "other_cell_groups.csv").write_text("Barcode,Clusters\n")
    with pytest.raises(FileExistsError):
        bundles.load_table_bundle(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        bundles.bundle_path(spark, str(tmp_path), None, "absent*")
    assert bundles.bundle_path(spark, str(tmp_path), "given", "absent*") == "given"
    with pytest.raises(NotImplementedError):
        bundles.read_expression(spark, "matrix.h5")


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "names.txt").write_text("".join(f"name{i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = bundles.numbered_lines(spark.read.text(str(tmp_path / "names.txt")))
        assert got.where(F.concat(F.lit("name"), F.col("line") - 1) != F.col("value")).count() == 0 and got.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_cluster_column_choice(spark):
    base = spark.createDataFrame([("c", 0.0, 0.0, "k", "m")], "cell_id string, x double, y double, cluster__a string, Clusters string")
    assert bundles.coerce_cells(base).first().Cluster == "m"
    assert bundles.coerce_cells(base.drop("Clusters")).first().Cluster == "k"
    assert bundles.coerce_cells(base.drop("Clusters", "cluster__a")).first().Cluster is None
    with pytest.raises(ValueError, match="coordinates"):
        bundles.coerce_cells(base.drop("x"))


def test_transcripts(spark):
    rows = [(0.0, 1.0, "G1"), (2.0, 3.0, "NegControlProbe_1"), (4.0, 5.0, "Unassigned_7")]
    got = bundles.transcript_points(spark.createDataFrame(rows, "x double, y double, gene_name string")).collect()
    assert [tuple(r) for r in got] == [(0.0, 1.0, "G1", None)]
    with pytest.raises(ValueError, match="feature_name"):
        bundles.transcript_points(spark.createDataFrame([(0.0, 1.0)], "x double, y double"))
    renamed = bundles.location_columns(spark.createDataFrame([(0.0, 1.0, "g")], "x double, y double, gene string"))
    assert renamed.columns == ["x_location", "y_location", "feature_name"]


def test_cluster_files(spark, tmp_path):
    for name, text in (("gene_expression_graphclust", "Barcode,Cluster\nc1,1\n"), ("gene_expression_kmeans_5_clusters", "barcode,cluster\nc1,2\nc2,3\n")):
        (tmp_path / "analysis/clustering" / name).mkdir(parents=True)
        (tmp_path / "analysis/clustering" / name / "clusters.csv").write_text(text)
    cells = spark.createDataFrame([("c1",), ("c2",)], "cell_id string")
    merged, columns, rates = bundles.merge_clusters(cells, str(tmp_path))
    assert columns == ["xoa_graphclust", "xoa_kmeans_5"]
    assert {r["column"]: r.hit_rate for r in rates.collect()} == {"xoa_graphclust": 0.5, "xoa_kmeans_5": 1.0}
    assert {r.cell_id: r.xoa_kmeans_5 for r in merged.collect()} == {"c1": "2", "c2": "3"}
    assert bundles.cluster_column("Gene_Expression_Custom_Clusters") == "xoa_custom"


def test_spot_positions(spark, tmp_path):
    (tmp_path / "spatial").mkdir()
    spark.createDataFrame([("b1", 3, 4, 1.5)], "barcode string, row int, col int, pxl_x double").toPandas().to_parquet(
        tmp_path / "spatial/tissue_positions.parquet")
    with pytest.raises(FileNotFoundError):
        bundles.read_spot_bundle(spark, str(tmp_path))
    (tmp_path / "filtered_feature_bc_matrix.h5").write_bytes(b"")
    with pytest.raises(NotImplementedError):
        bundles.read_spot_bundle(spark, str(tmp_path))
    row = bundles.read_spot_bundle(spark, str(tmp_path), counts=False).cells.first()
    assert (row.array_row, row.array_col, row.x, row.y, row.in_tissue) == (3, 4, 1.5, 0.0, 0)


def test_matrix_files(spark, tmp_path):
    (tmp_path / "t_and_c_result_a.csv").write_text(",A,B\ng1,0.1,\ng2,x,0.4\n")
    (tmp_path / "StructureMap_table_a.csv").write_text(",A,B\nA,0,1\nB,1,0\n")
    topology, structure = bundles.precomputed_tables(spark, str(tmp_path))
    assert {(r.gene, r.celltype): r.value for r in topology.collect()} == {
        ("g1", "A"): 0.1, ("g1", "B"): None, ("g2", "A"): None, ("g2", "B"): 0.4}
    assert structure.count() == 4
    assert bundles.precomputed_tables(spark, str(tmp_path / "t_and_c_result_a.csv"))[1].count() == 4
    path = write_matrix_csv(structure, str(tmp_path / "out.csv"), "row", "col")
    assert spark.read.csv(path, header=True).columns == ["row", "A", "B"]
    assert spark.read.parquet(write_table(structure, str(tmp_path / "out.parquet"))).count() == 4


def test_selection_and_landmark(spark, tmp_path):
    (tmp_path / "sel.csv").write_text("#Selection\n#two\nCell ID,Cluster\nc2,A\n")
    cells = spark.createDataFrame([("c1", "A"), ("c2", "B")], "cell_id string, celltype string")
    chosen = bundles.read_selection(spark, str(tmp_path / "sel.csv"))
    assert [r.cell_id for r in samples.selected(cells, chosen).collect()] == ["c2"]
    assert sorted(r.celltype for r in samples.with_landmark(cells, chosen).collect()) == ["A", "B", "Landmark"]


def test_reference_and_expression_coercion(spark):
    df = spark.createDataFrame([(2, 1.0, 0.0, "B"), (1, 0.0, 0.0, "A")], "ord int, x double, y double, kind string")
    got = points.coerce_reference(df, celltype_col="kind", order_col="ord").collect()
    assert {r.cell_id: r.celltype for r in got} == {"cell_0": "A", "cell_1": "B"}
    with pytest.raises(ValueError, match="order_col"):
        points.coerce_reference(df, celltype_col="kind")
    raw = spark.createDataFrame([("cell_0", "g", "2.5"), ("cell_0", "h", "x"), ("other", "g", "1")], "cell_id string, gene string, value string")
    reference = points.coerce_reference(df, celltype_col="kind", order_col="ord")
    assert [(r.gene, r.value) for r in points.coerce_expression(raw, reference).collect()] == [("g", 2.5)]


def test_rank_sum_by_hand(spark):
    df = spark.createDataFrame([("k", "a", 1.0), ("k", "a", 2.0), ("k", "b", 3.0), ("k", "b", 4.0), ("l", "a", 1.0), ("l", "b", 2.0)],
                               "key string, outcome string, value double")
    rows = {r.key: r for r in samples.rank_sum(df, ["key"]).collect()}
    z = 1.5 / (4 * 5 / 12) ** 0.5
    assert rows["k"].W == 0.0 and rows["k"].z == pytest.approx(z)
    assert rows["k"].p_value == pytest.approx(math.erfc(z / 2**0.5), rel=1e-12)
    assert (rows["l"].n1, rows["l"].n2, rows["l"].W, rows["l"].z, rows["l"].p_value) == (1, 1, 0.0, None, None)


def test_rank_sum_with_one_key_of_nearly_all_rows(spark):
    df = spark.range(6000).select(
        F.when(F.col("id") < 5900, "hot").otherwise("cold").alias("key"), (F.col("id") % 2).alias("arm"),
        F.when(F.col("id") % 3 == 0, "u").otherwise("v").alias("outcome"), F.floor(F.pow(F.col("id") % 97, F.lit(2)) / 3).alias("value"))
    got = {(r.key, r.arm): r for r in samples.rank_sum(df, ["key", "arm"]).collect()}
    frame = df.toPandas()
    for (key, arm), part in frame.groupby(["key", "arm"]):
        rank = part.value.rank()
        own = part.outcome == "u"
        n1, n2, n = own.sum(), (~own).sum(), len(part)
        w = rank[own].sum() - n1 * (n1 + 1) / 2
        ties = (part.value.value_counts() ** 3 - part.value.value_counts()).sum()
        z = (abs(w - n1 * n2 / 2) - 0.5) / (n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) ** 0.5
        assert (got[key, arm].W, got[key, arm].z) == (w, pytest.approx(z))
        assert got[key, arm].p_value == pytest.approx(math.erfc(z / 2**0.5), abs=1e-13)


def test_samples_named_by_two_columns(spark):
    rows = [(p, f, float(i), 0.0, "AB"[i % 2]) for p in ("p1", "p2") for f in (1, 2) for i in range(4 + f)]
    df = spark.createDataFrame(rows, "patient string, phase int, x double, y double, celltype string")
    both = {(r.patient, r.phase, r.source, r.target): r.value for r in samples.sample_matrices(df, ["patient", "phase"]).collect()}
    one = {(r.source, r.target): r.value for r in searcher_findee(df.where("patient = 'p2' and phase = 1")).collect()}
    assert len(both) == 16 and {k[2:]: v for k, v in both.items() if k[:2] == ("p2", 1)} == one
    kept = samples.sample_sizes(df, ["patient", "phase"], min_points=6).collect()
    assert {(r.patient, r.phase): (r.n_points, r.kept) for r in kept} == {
        (p, f): (4 + f, f == 2) for p in ("p1", "p2") for f in (1, 2)}


def test_repeated_barcodes_are_reported(spark):
    cells = spark.createDataFrame([("c1",), ("c2",)], "cell_id string")
    twice = spark.createDataFrame([("c1", "1"), ("c1", "2")], "Barcode string, Cluster string")
    with pytest.raises(ValueError, match="c1"):
        samples.map_clusters(cells, {"k": twice})
    same = spark.createDataFrame([("c1", "1"), ("c1", "1")], "BARCODE string, cluster string")
    assert {r.cell_id: r.k for r in samples.map_clusters(cells, {"k": same})[0].collect()} == {"c1": "1", "c2": None}


def test_clusters_by_label_id(spark, tmp_path):
    where = tmp_path / "analysis/clustering/graphclust"
    where.mkdir(parents=True)
    (where / "clusters.csv").write_text("Barcode,Cluster\nb7,1\n")
    masks = spark.createDataFrame([("7.0",), ("8.0",)], "cell_id string")
    lookup = spark.createDataFrame([(7, "b7"), (8, "b8")], "label_id int, cell_id string")
    merged, columns, _ = bundles.merge_clusters(masks, f"file:{tmp_path}", label_ids=lookup)
    assert {r.cell_id: r.xoa_graphclust for r in merged.collect()} == {"7.0": "1", "8.0": None}


def test_loaders_take_any_address(spark, tmp_path):
    folder = f"file:{bundle(spark, tmp_path)}"
    assert bundles.load_table_bundle(spark, folder).cells.count() == 2 and bundles.load_cells(spark, folder).raw.count() == 3
    spark.createDataFrame([(0.0, 1.0, "G1")], "x double, y double, gene_name string").toPandas().to_parquet(tmp_path / "transcripts.parquet")
    assert bundles.load_transcripts(spark, folder).count() == 1
    (tmp_path / "t_and_c_result_a.csv").write_text(",A\ng1,0.1\n")
    assert bundles.precomputed_tables(spark, folder)[0].count() == 1


def test_wide_files_come_back(spark, tmp_path):
    names = [f'c{i:05d}, "x"' if i % 2 else f"c{i:05d}" for i in range(6000)]
    rows = [(f"r{i}", c, float(i) + j / 7) for i in range(3) for j, c in enumerate(names) if (i + j) % 3] + [("r9", names[0], None)]
    df = spark.createDataFrame(rows, "row string, col string, value double").repartition(4)
    path = write_matrix_csv(df, str(tmp_path / "wide.csv"), "row", "col")
    back = {(r.row, r.col): r.value for r in bundles.read_matrix_csv(spark, path).collect()}
    assert len(back) == 4 * 6000 and {k: v for k, v in back.items() if v is not None} == {(a, b): v for a, b, v in rows if v is not None}
    filled = bundles.read_matrix_csv(spark, write_matrix_csv(df, str(tmp_path / "filled.csv"), "row", "col", fill=0.0)).where("value = 0").count()
    assert filled == 4 * 6000 - len(rows) + 1 + sum(v == 0 for *_, v in rows)


def test_files_are_found_however_deep(spark, tmp_path):
    deep = tmp_path.joinpath(*"abcdefghij")
    deep.mkdir(parents=True)
    for folder in (deep, tmp_path):
        (folder / "clusters.csv").write_text("x\n")
    assert len(files.below(spark, str(tmp_path), "clusters.csv")) == 2 and files.below(spark, str(tmp_path / "none"), "clusters.csv") == []


def test_streamed_sums_equal_the_batch_matrix(spark, tmp_path):
    everyone = synthetic.modular(spark, [(0, 0), (4, 0), (9, 3)], points=40, seed=3).repartition(4)
    everyone.write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    accumulate(stream, stored, str(tmp_path / "sums"), str(tmp_path / "state")).awaitTermination(120)
    got = {(r.source, r.target): r.value for r in accumulated(spark, str(tmp_path / "sums")).collect()}
    want = {(r.source, r.target): r.value for r in searcher_findee(stored).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-12


def test_synthetic_clouds_and_figures(spark):
    rings = synthetic.nested(spark, [(0, 1, 50), (2, 3, 70)], seed=1)
    radius = rings.groupBy("celltype").agg(F.max(F.hypot("x", "y")).alias("r"), F.count("*").alias("n")).collect()
    assert {r.celltype: (r.r <= {"C0": 1, "C1": 3}[r.celltype], r.n) for r in radius} == {"C0": (True, 50), "C1": (True, 70)}
    assert synthetic.scattered(spark, 3, points=20).count() == 60
    matrix = searcher_findee(rings)
    data = figures.heatmap_data(matrix, row="source", col="target")
    assert sorted(r.row_position for r in data.collect()) == [0, 0, 1, 1]
    percent = matrix.select("source", "target", F.lit(25.0).alias("value"))
    circles = figures.circle_data(matrix, percent, exponent=0.5, max_area=100, row="source", col="target")
    assert {r.area for r in circles.collect()} == {50.0}
    with pytest.raises(ValueError):
        figures.circle_data(matrix, percent.limit(3), row="source", col="target")
    assert figures.titles("row_coph", "S")[1] == "StructureMap_of_S.pdf" and figures.titles("x", "S")[0] == "D score of S"
