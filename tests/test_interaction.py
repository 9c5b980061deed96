"""Ligand-receptor and pathway layers on a small two-block layout, and entity placement."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelscape import api
from labelscape.operators import anchors as an
from labelscape.operators import contact, entity, pathway
from labelscape.operators import interaction as ia
from labelscape.operators.expression import normalize_log_scale, nonzero_ranks, ranks, sparse_log_scale, sparse_ranks, summarize_by_celltype
from labelscape.operators.matrices import searcher_findee
from labelscape.operators.structure import structure_map
from labelscape.plans.interaction import ligand_receptor_topology
from labelscape.plans.pathway import pathway_topology
from tests import brute

LABELS = ["Sender"] * 4 + ["Rare"] * 2 + ["Receiver"] * 4
XY = np.array([[0, 0], [0, 1], [1, 0], [1, 1.1], [6, 6], [6.5, 6], [1.8, 0.1], [2, 1], [2.1, 0.4], [2.9, 0.9]])
GENES = {
    "LIG": [9, 8, 9, 7, 0, 0, 0, 0, 1, 0], "REC": [0, 1, 0, 0, 0, 0, 8, 9, 9, 7], "OTHER": [0, 0, 0, 0, 5, 6, 0, 0, 0, 1],
    "P1": [5, 4, 5, 4, 0, 0, 1, 0, 0, 0], "P2": [3, 3, 2, 4, 0, 1, 0, 0, 0, 0], "SPARSE": [0, 0, 0, 0, 2, 3, 0, 0, 0, 0],
}


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame(pd.DataFrame(XY, columns=["x", "y"]).assign(
        cell_id=[f"cell_{i}" for i in range(10)], celltype=LABELS))


@pytest.fixture(scope="module")
def expression(spark):
    rows = [(f"cell_{i}", g, float(v)) for g, vs in GENES.items() for i, v in enumerate(vs) if v]
    return spark.createDataFrame(rows, "cell_id string, gene string, value double")


@pytest.fixture(scope="module")
def topology(spark):
    near = {"LIG": (0.1, 0.9, 0.8), "REC": (0.8, 0.9, 0.1), "P1": (0.1, 0.9, 0.7), "P2": (0.2, 0.8, 0.9)}
    return spark.createDataFrame([(g, c, v) for g, vs in near.items() for c, v in zip(("Sender", "Rare", "Receiver"), vs)],
                                 "gene string, celltype string, value double")


@pytest.fixture(scope="module")
def structure(spark):
    near = {("Sender", "Receiver"): 0.2, ("Sender", "Rare"): 1.0, ("Receiver", "Rare"): 0.9}
    rows = [(a, b, v) for (a, b), v in near.items()] + [(b, a, v) for (a, b), v in near.items()]
    return spark.createDataFrame(rows, "row string, col string, value double")


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "ligand string, receptor string, evidence_weight double")


def test_best_pair_with_given_anchors(spark, cells, expression, topology, structure, tmp_path):
    got = ligand_receptor_topology(cells, expression, pairs(spark, ("LIG", "REC", 1.0)), topology=topology, structure=structure,
                                   k_neighbors=3, radius=1.5, min_cross_edges=1, output_dir=str(tmp_path))
    best = got.scores.first()
    assert (best.sender_celltype, best.receiver_celltype) == ("Sender", "Receiver")
    assert best.anchor_source_ligand == best.structure_map_source == "precomputed"
    assert got.scores.count() == 9 and 0 < best.LR_score <= 1 + 1e-7
    for path in got.files.values():
        assert (tmp_path / path.split("/")[-1] / "_SUCCESS").exists()
    hot = spark.read.parquet(got.files["lr_hotspot_cells_parquet"])
    assert {r.role for r in hot.select("role").collect()} == {"sender", "receiver"}


def test_missing_anchors_are_recomputed(spark, cells, expression, topology, structure):
    asked = pairs(spark, ("LIG", "OTHER", 1.0))
    got = ligand_receptor_topology(cells, expression, asked, topology=topology, structure=structure, anchor_mode="hybrid",
                                   radius=1.5, min_cross_edges=1)
    assert {r.gene: r.source for r in got.anchor_sources.collect()} == {"LIG": "precomputed", "OTHER": "recompute"}
    again = ligand_receptor_topology(cells, expression, asked, radius=1.5, min_cross_edges=1)
    row = again.scores.first()
    assert row.anchor_source_ligand == row.structure_map_source == "recompute"


def test_structure_sources(spark, cells, expression, structure):
    genes = spark.createDataFrame([("LIG",)], "gene string")
    assert an.resolve_anchors(cells, expression, genes, provided_structure=structure).structure_source == "precomputed"
    assert an.resolve_anchors(cells, expression, genes, provided_structure=structure, anchor_mode="recompute").structure_source == "provided"
    got = an.resolve_anchors(cells, expression, genes, structure=structure.where("row <> 'Rare'"))
    filled = {(r.row, r.col): r.value for r in got.structure.collect()}
    assert filled["Rare", "Sender"] == 1 and filled["Rare", "Rare"] == 0 and len(filled) == 9
    with pytest.raises(ValueError, match="anchor_mode"):
        an.resolve_anchors(cells, expression, genes, anchor_mode="other")


def test_too_few_edges_give_no_contact(spark, cells, expression, topology, structure):
    got = ligand_receptor_topology(cells, expression, pairs(spark, ("LIG", "REC", 1.0)), topology=topology, structure=structure,
                                   radius=1.5, min_cross_edges=999).scores.toPandas()
    assert (got.local_contact == 0).all() and got.LR_score.notna().all() and (got.LR_score > 0).all()


def test_contact_by_loops(spark, cells, expression):
    ids = [f"cell_{i}" for i in range(10)]
    edges = [(i, j) for i in range(10) for j in range(10) if i != j and np.hypot(*(XY[i] - XY[j])) <= 1.5]
    table = spark.createDataFrame([(ids[i], ids[j]) for i, j in edges], "cell_id string, neighbor string")
    standard = ia.standard_pairs(pairs(spark, ("LIG", "REC", 1.0)))
    got = contact.local_contact(cells, expression, table, standard, min_cross_edges=1).toPandas()
    scaled, active = {}, {}
    for g in ("LIG", "REC"):
        v = np.array(GENES[g], dtype=float)
        clipped = np.minimum(v, np.quantile(v, 0.99))
        scaled[g], active[g] = clipped / clipped.max(), v > np.quantile(v[v > 0], 0.75)
    for r in got.itertuples():
        own = [(i, j) for i, j in edges if LABELS[i] == r.sender and LABELS[j] == r.receiver]
        assert r.cross_edge_count == len(own)
        want = np.mean([scaled["LIG"][i] * scaled["REC"][j] for i, j in own]) if own else 0.0
        cover = np.mean([active["LIG"][i] and active["REC"][j] for i, j in own]) if own else 0.0
        assert abs(r.contact_strength_raw - want) < 1e-12 and abs(r.contact_coverage - cover) < 1e-12


def test_prior_scaling_keeps_repeated_pairs(spark):
    got = ia.standard_pairs(pairs(spark, ("A", "B", 1.0), ("A", "B", 3.0), ("C", "D", 2.0)))
    assert sorted(r.prior_confidence for r in got.collect()) == [0, 0.5, 1] and got.select("pair_id").distinct().count() == 3
    plain = ia.standard_pairs(pairs(spark, ("A", "B", 9.0)), prior_col="absent")
    assert plain.first().prior_confidence == 1
    with pytest.raises(ValueError, match="receptor"):
        ia.standard_pairs(spark.createDataFrame([("A",)], "ligand string"))


def test_target_consistency(spark):
    scores = spark.createDataFrame([("L", "R", 0.5), ("M", "R", 0.5)], "ligand string, receiver_celltype string, LR_score double")
    prior = spark.createDataFrame([("L", "T1", 0.6), ("L", "T3", 0.4), ("Z", "T1", 1.0)], "ligand string, target string, weight double")
    got = {r.ligand: r for r in ia.target_consistency(scores, {"R": {"T1": 2.0, "T2": 1.0}}, prior).collect()}
    assert got["L"].target_support == 1 and got["M"].target_support == 0
    assert got["L"].topology_and_target_supported == pytest.approx(0.5**0.5)
    one = ia.target_consistency(scores.where("ligand = 'L'"), {"R": ["T1"]}, prior).first()
    assert one.target_support == 1


def test_summary_counts_cells_without_values(cells, expression):
    got = {(r.gene, r.celltype): r for r in summarize_by_celltype(expression, cells).collect()}
    row = got["LIG", "Receiver"]
    assert row.share == pytest.approx(1 / 34) and row.detected == 0.25 and row.raw == pytest.approx(1 / 34 * 0.5)
    assert got["LIG", "Sender"].normalized == 1 and got["LIG", "Rare"].normalized == 0


def test_ranks_include_zeros(spark, cells, expression):
    genes = spark.createDataFrame([(g,) for g in GENES], "gene string")
    got = ranks(expression, cells, genes).toPandas().pivot(index="cell_id", columns="gene", values="rank")
    want = pd.DataFrame(GENES, index=[f"cell_{i}" for i in range(10)]).rank(axis=1, pct=True)
    assert np.allclose(got.sort_index()[list(GENES)], want.sort_index())
    for few, full in ((sparse_ranks(expression, cells, genes), ranks(expression, cells, genes)),
                      (sparse_log_scale(expression, cells, genes), normalize_log_scale(expression, cells, genes))):
        assert few.rows.count() == expression.join(genes, "gene").where("value <> 0").count() < full.count()
        mean = full.join(cells, "cell_id").groupBy("celltype", "gene").agg(F.avg(few.value).alias("mean"))
        both = few.mean_by_label(cells, genes).join(mean, ["celltype", "gene"])
        assert both.count() == 3 * len(GENES) and both.where(F.abs(F.col(few.value) - F.col("mean")) > 1e-12).count() == 0
    signed = spark.createDataFrame([("c", "a", -1.0), ("c", "b", 2.0)], "cell_id string, gene string, value double")
    rows = {r.gene: (r.rank, r.zero_rank) for r in nonzero_ranks(signed, F.lit(4)).collect()}
    assert rows == {"a": (0.25, 0.625), "b": (1.0, 0.625)}


def test_one_gene_activity_is_scaled_expression(spark, cells, expression):
    sets = pathway.standard_pathways({"solo": ["LIG"]}, spark)
    got = pathway.pathway_activity(expression, cells, sets, method="weighted_sum").toPandas().set_index("cell_id").value
    assert np.allclose(got[[f"cell_{i}" for i in range(10)]], np.array(GENES["LIG"]) / 9)


def test_activity_methods_and_unknown_genes(spark, cells, expression):
    sets = pathway.standard_pathways({"known": {"P1": 2.0, "P2": -1.0, "NONE": 5.0}, "unknown": ["NONE"]}, spark)
    wide = pd.DataFrame(GENES, index=[f"cell_{i}" for i in range(10)])
    calls = {m: pathway.pathway_activity(expression, cells, sets, method=m, normalize=False).toPandas() for m in
             pathway.RANK_METHODS + pathway.SUM_METHODS}
    for m, pdf in calls.items():
        got = pdf.pivot(index="cell_id", columns="pathway", values="value").loc[wide.index]
        rank = wide.rank(axis=1, pct=True)
        want = (2 * rank.P1 + rank.P2) / 3 if m in pathway.RANK_METHODS else (2 * wide.P1 - wide.P2) / 3
        assert np.allclose(got["known"], want) and (got["unknown"] == 0).all()
    with pytest.raises(ValueError, match="method"):
        pathway.pathway_activity(expression, cells, sets, method="other")


def test_both_pathway_modes(spark, cells, expression, topology, structure, tmp_path):
    sets = {"one": ["P1", "P2"], "two": ["LIG", "REC"], "sparse": ["SPARSE"]}
    got = pathway_topology(cells, expression, sets, topology=topology, structure=structure, min_activity_cells=3,
                           activity_threshold_schedule=(0.95, 0.8, 0.5), output_dir=str(tmp_path))
    assert got.pathway_to_cell is got.gene_topology_aggregate
    table = {r.pathway: r for r in got.pathway_mode_comparison.collect()}
    assert table["one"].aggregate_best_celltype == "Sender" and set(table) == set(sets)
    assert table["one"].retained_cell_count >= 3 and table["sparse"].retained_quantile == 0.5
    assert len(got.files) == 7
    smoothed = pathway_topology(cells, expression, sets, topology=topology, structure=structure, view="niche_smoothed",
                                primary_pathway_mode="activity_point_cloud", min_activity_cells=3, k_neighbors=2)
    assert {r.activity_mode for r in smoothed.activity_diagnostics.collect()} == {"niche_smoothed"}
    with pytest.raises(ValueError, match="view"):
        pathway_topology(cells, expression, sets, view="other")
    with pytest.raises(ValueError, match="primary"):
        pathway_topology(cells, expression, sets, pathway_modes=["activity_point_cloud"])


def test_activity_points_fall_back_to_the_highest_cells(spark, cells):
    rows = [(f"cell_{i}", "p", float(v)) for i, v in enumerate([0, 0, 3, 0, 5, 0, 0, 0, 0, 0])]
    activity = spark.createDataFrame(rows, "cell_id string, pathway string, value double")
    points, diagnostics = pathway.activity_points(cells, activity, min_cells=4, schedule=(0.9, 0.5))
    d = diagnostics.first()
    assert (d.retained_cell_count, d.retained_quantile) == (4, 0.5)
    assert sorted(r.cell_id for r in points.collect()) == ["cell_0", "cell_1", "cell_2", "cell_4"]


def entity_row(xy, labels, cloud, weights, name):
    names, matrix = brute.label_matrix(np.vstack([xy, cloud]), np.append(labels, [name] * len(cloud)),
                                       np.append(np.ones(len(xy)), weights))
    full = brute.average_map(matrix)
    return dict(zip(names, full[list(names).index(name)]))


def test_entities_match_full_recomputation(spark, cells):
    rng = np.random.default_rng(5)
    clouds = {"g1": (rng.uniform(0, 7, (5, 2)), rng.uniform(1, 3, 5)), "Rare": (rng.uniform(0, 3, (3, 2)), np.full(3, 2.0))}
    rows = [(n, float(x), float(y), float(w)) for n, (xy, ws) in clouds.items() for (x, y), w in zip(xy, ws)]
    rows.append(("empty", 1.0, 1.0, 0.0))
    points = spark.createDataFrame(rows, "entity string, x double, y double, weight double")
    got = {(r.entity, r.celltype): r.value for r in entity.entity_to_cell(cells, points).collect()}
    for name, (xy, ws) in clouds.items():
        for label, v in entity_row(XY, LABELS, xy, ws, name).items():
            if label in LABELS:
                assert got[name, label] == pytest.approx(v, abs=1e-12)
    assert got["empty", "Sender"] is None and len(got) == 9
    heavy = points.withColumn("weight", F.lit(2.0)).unionByName(spark.createDataFrame([("Rare", 0.0, 0.0, 2.0)], points.schema))
    got = {(r.entity, r.celltype): r.value for r in entity.entity_to_cell(cells, heavy, min_weight=1.0).collect()}
    assert len(got) == 9 and {k for k, v in got.items() if v is not None} == {("Rare", "Rare")} and got["Rare", "Rare"] == 0


def test_transcripts_skip_own_label_and_silent_genes(spark, cells):
    points = spark.createDataFrame([(0.5, 0.5, "g"), (6.2, 6.0, "Rare")], "x double, y double, feature_name string")
    genes = spark.createDataFrame([("g",), ("Rare",), ("silent",), ("Sender",)], "gene string")
    base, rows = entity.transcript_to_cell(cells, points, genes=genes)
    got = {(r.gene, r.celltype): r.value for r in rows.collect()}
    smap = {(r.row, r.col): r.value for r in structure_map(searcher_findee(cells)).collect()}
    assert got["Sender", "Receiver"] == smap["Sender", "Receiver"] and ("Sender", "Sender") not in got
    assert got["silent", "Rare"] is None and ("Rare", "Rare") not in got and got["g", "Sender"] is not None


def test_negative_expression_moves_absent_cells_too(spark, cells):
    values = spark.createDataFrame([("cell_0", "g", -2.0), ("cell_1", "g", 1.0)], "cell_id string, gene string, value double")
    got = {r.cell_id: r.weight for r in entity.entity_points(cells, values).collect()}
    assert got == {"cell_1": 3.0, **{f"cell_{i}": 2.0 for i in range(2, 10)}}


def test_public_names(cells, spark):
    rows, cols, near = api.compute_cophenetic_distances_from_adata(cells)
    assert near.count() == 30 and rows.count() == cols.count() == 9
    assert api.generate_TCR_distance_heatmap_from_df(cells).count() == 9
    assert api.generate_TCR_distance_heatmap_from_df(cells.where("celltype = 'Rare'")) is None


def test_pathway_sums_are_made_where_a_cell_is(spark, monkeypatch):
    reference = spark.range(30).select(F.col("id").alias("cell_id"))
    values = reference.select("cell_id", F.explode(F.array(F.lit("g1"), F.lit("g2"), F.lit("g3"))).alias("gene"), (F.col("cell_id") + 1.0).alias("value"))
    sets = spark.createDataFrame([("p", "g1", 1.0), ("p", "g2", 3.0), ("q", "g3", 2.0)], "pathway string, gene string, weight double")

    def activity():
        return pathway.pathway_activity(values, reference, sets, method="weighted_sum", normalize=False)

    assert "REPARTITION_BY_COL" in activity()._jdf.queryExecution().toString()  # the values meet by cell, before pathways multiply them
    found = {(r["cell_id"], r["pathway"]): r["value"] for r in activity().collect()}
    assert found == {(i, p): i + 1.0 for i in range(30) for p in "pq"}
    monkeypatch.setattr(pathway, "FEW_MEMBERS", 0)  # more members than may go to every task
    assert {(r["cell_id"], r["pathway"]): r["value"] for r in activity().collect()} == found
