"""Transcript analysis from a folder to result files."""

import numpy as np
import pytest

from labelscape import api
from labelscape.operators.entity import transcript_to_cell
from labelscape.plans.transcripts import counts_by_group


@pytest.fixture
def folder(spark, tmp_path):
    rng = np.random.default_rng(2)
    cells = [(f"c{i}", *map(float, rng.uniform(0, 9, 2)), "AB"[i % 2]) for i in range(12)]
    spark.createDataFrame(cells, "cell_id string, x_centroid double, y_centroid double, cluster string").toPandas().to_parquet(
        tmp_path / "cells.parquet")
    molecules = [(*map(float, rng.uniform(0, 9, 2)), f"G{i % 2}", f"c{i % 13}") for i in range(40)] + [(1.0, 1.0, "NegControlProbe", "c0")]
    spark.createDataFrame(molecules, "x double, y double, feature_name string, cell_id string").toPandas().to_parquet(
        tmp_path / "transcripts.parquet")
    spark.createDataFrame([("c0", f"G{i}", 1.0) for i in range(3)], "cell_id string, gene string, value double").toPandas().to_parquet(
        tmp_path / "cell_feature_matrix.parquet")
    return tmp_path


def test_folder_to_files(spark, folder):
    out = api.transcript_by_cell_analysis(spark, f"file:{folder}", sample_name="s", output_folder=f"{folder}/out")
    assert {k: v.rpartition("/")[2] for k, v in out.files.items()} == {
        "structure": "StructureMap_table_s.csv", "topology": "t_and_c_result_s.csv", "counts": "counts_s.csv"}
    rows = {(r.gene, r.celltype): r.value for r in out.topology.collect()}
    assert len(rows) == 6 and rows["G2", "A"] is None and rows["G0", "A"] is not None
    cells = spark.read.parquet(f"{folder}/cells.parquet").selectExpr("x_centroid x", "y_centroid y", "cluster celltype")
    points = spark.read.parquet(f"{folder}/transcripts.parquet").where("feature_name like 'G%'")
    plain = {(r.gene, r.celltype): r.value for r in transcript_to_cell(cells, points)[1].collect()}
    assert {k: v for k, v in rows.items() if k[0] != "G2"} == pytest.approx(plain)
    wide = spark.read.csv(out.files["topology"], header=True)
    assert wide.columns == ["gene", "A", "B"] and wide.count() == 3
    counts = {(r.gene, r.celltype): r["count"] for r in out.counts.collect()}
    assert sum(counts.values()) == 40 and ("G0", None) in counts


def test_a_group_table_takes_the_clusters_place(spark, folder):
    groups = spark.createDataFrame([(f"c{i}", "left" if i < 6 else "right") for i in range(11)], "cell_id string, group string")
    out = api.transcript_by_cell_analysis(spark, str(folder), groups=groups)
    assert out.files == {} and {r.row for r in out.structure.select("row").distinct().collect()} == {"left", "right"}


def test_counts_by_hand(spark):
    cells = spark.createDataFrame([("a", "X"), ("b", None)], "cell_id string, celltype string")
    molecules = spark.createDataFrame([("a", "g"), ("a", "g"), ("b", "g"), (None, "g"), ("z", "h")], "cell_id string, feature_name string")
    got = {(r.gene, r.celltype): r["count"] for r in counts_by_group(molecules, cells).collect()}
    assert got == {("g", "X"): 2, ("g", None): 2, ("h", None): 1}
