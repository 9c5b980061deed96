"""Runnable queries over the given tables, one per operator; SQL twins are in ``oracles``.

Bindings: customers are cells (x = balance / 100, y = nation key, label = market segment), parts and
embeddings are point clouds, and the quantity of each brand or type a customer ordered is expression. Points have two or three
coordinates by definition, so an embedding's first numbers are its place; every row of the table is one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelscape.operators import (
    anchors as an, binned, contact, enrichment as en, entity, expression as ex, interaction as ia, matrices as mx, neighbors as nb,
    pathway as pw, samples as sm, structure as st,
)
from labelscape.plans.interaction import ligand_receptor_topology
from labelscape.plans.pathway import niche_smoothed, pathway_topology
from labelscape.plans.transcripts import counts_by_group
from labelscape.render import figures
from labelscape.session import written
from labelscape.streaming.accumulate import partial_sums
from labelscape.streaming.arriving import closer_places, matrix_of_closest, source_places

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits (and no negative zero), so that both engines print the same value."""
    return df.select(*[_rounded(c).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _rounded(column: str) -> Column:
    """Round goes through a decimal number, which costs more than most rows; whole millionths are the same value unless it is large or near a half."""
    value, unit = F.col(column), 10.0**DIGITS
    whole = F.floor(value * unit + 0.5)
    sure = (F.abs(value) < 1e6) & (F.abs(value * unit - whole) < 0.499)
    return F.when(sure, whole / F.lit(unit)).otherwise(F.round(value, DIGITS) + F.lit(0.0))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cells(spark, folder) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("cell_id"), (F.col("c_acctbal") / 100).alias("x"),
        F.col("c_nationkey").cast("double").alias("y"), F.col("c_mktsegment").alias("celltype"))


def expression(spark, folder, gene: str = "p_brand") -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, folder, "part").select("p_partkey", gene)
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        F.col("o_custkey").alias("cell_id"), F.col(gene).alias("gene")).agg(F.sum("l_quantity").alias("value"))


def text_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("cell_id", F.col("cell_id").cast("string"))


def genes(spark, folder) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_brand").alias("gene")).distinct()


def event_expression(spark, folder) -> DataFrame:
    return table(spark, folder, "events").groupBy(
        F.col("user_id").alias("cell_id"), F.col("event_type").alias("gene")).agg(F.sum("value").alias("value"))


def vectors(spark, folder) -> DataFrame:
    axes = [F.col("embedding")[i].cast("double").alias(name) for i, name in enumerate("xyz")]
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("cell_id"), *axes,
        F.col("label").cast("string").alias("celltype"))


def parts(spark, folder) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("cell_id"), F.col("p_size").cast("double").alias("x"),
        (F.col("p_retailprice") / 40).alias("y"), F.col("p_brand").alias("celltype"))


def located_suppliers(spark, folder) -> DataFrame:
    suppliers = table(spark, folder, "supplier").join(
        table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return suppliers.select((F.col("s_acctbal") / 100).alias("x"), F.col("s_nationkey").cast("double").alias("y"),
                            F.col("r_name").alias("celltype"))


def sampled_cells(spark, folder) -> DataFrame:
    nations = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return cells(spark, folder).join(
        nations.select(F.col("n_nationkey").cast("double").alias("y"), F.col("r_name").alias("sample")), "y")


def brand_pairs(spark, folder) -> DataFrame:
    """Each brand with the next one by name; evidence is the first brand's number of parts."""
    count = table(spark, folder, "part").groupBy(F.col("p_brand").alias("ligand")).agg(
        F.count("*").cast("double").alias("evidence_weight"))
    following = F.lead("ligand").over(Window.orderBy("ligand"))
    return count.withColumn("receptor", following).where("receptor is not null")


def type_sets(spark, folder) -> DataFrame:
    """Part types as gene sets of brands, weighted by the number of parts."""
    return table(spark, folder, "part").groupBy(F.col("p_type").alias("pathway"), F.col("p_brand").alias("gene")).agg(
        F.count("*").cast("double").alias("weight"))


def derived_topology(spark, folder, values: DataFrame | None = None) -> DataFrame:
    """Given gene-to-label distances in [0, 1]: one minus the detected fraction."""
    return ex.summarize_by_celltype(expression(spark, folder) if values is None else values, cells(spark, folder), detection_threshold=50).select(
        "gene", "celltype", (1 - F.col("detected")).alias("value"))


def detected_map(spark, folder) -> DataFrame:
    """Given label-to-label map: the mean distance over its largest value."""
    matrix = written(mx.searcher_findee(cells(spark, folder)))
    top = matrix.agg(F.max("value")).scalar()
    return matrix.select(F.col("source").alias("row"), F.col("target").alias("col"), (F.col("value") / top).alias("value"))


def transcripts(spark, folder) -> DataFrame:
    """One molecule per order line at its customer's place, named by part type."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    kinds = table(spark, folder, "part").select("p_partkey", "p_type")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return lines.join(kinds, F.col("l_partkey") == F.col("p_partkey")).join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        cells(spark, folder).select("cell_id", "x", "y"), F.col("o_custkey") == F.col("cell_id")).select(
        "x", "y", F.col("p_type").alias("feature_name"))


def brand_anchors(spark, folder, values: DataFrame) -> an.Anchors:
    own = genes(spark, folder)
    return an.resolve_anchors(cells(spark, folder), values, own, topology=derived_topology(spark, folder, values),
                              structure=detected_map(spark, folder))


def brand_contact(spark, folder, values: DataFrame | None = None) -> DataFrame:
    everyone = cells(spark, folder)
    pairs = ia.standard_pairs(brand_pairs(spark, folder))
    return contact.local_contact(everyone, expression(spark, folder) if values is None else values,
                                 nb.neighbor_edges(everyone, k_neighbors=6), pairs, min_cross_edges=20)


def brand_scores(spark, folder, values: DataFrame | None = None) -> DataFrame:
    values = written(expression(spark, folder)) if values is None else values
    pairs = ia.standard_pairs(brand_pairs(spark, folder))
    summary = ex.summarize_by_celltype(values, cells(spark, folder))
    return written(ia.pair_scores(pairs, brand_anchors(spark, folder, values), summary, brand_contact(spark, folder, values)))


def recomputed_scores(spark, folder) -> DataFrame:
    return ligand_receptor_topology(
        cells(spark, folder), expression(spark, folder), brand_pairs(spark, folder), anchor_mode="recompute",
        k_neighbors=6, min_cross_edges=20).scores


def target_prior(spark, folder) -> DataFrame:
    """Ligand brand to target part type, weighted by size."""
    return table(spark, folder, "part").groupBy(F.col("p_brand").alias("ligand"), F.col("p_type").alias("target")).agg(
        F.sum("p_size").cast("double").alias("weight"))


def receiver_signatures(spark, folder) -> DataFrame:
    """Part types ordered by each segment above the overall mean quantity per order line."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(
        table(spark, folder, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).join(
        table(spark, folder, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(
        table(spark, folder, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    overall = table(spark, folder, "lineitem").agg(F.avg("l_quantity")).scalar()
    means = lines.groupBy(F.col("c_mktsegment").alias("receiver_celltype"), F.col("p_type").alias("gene")).agg(
        F.avg("l_quantity").alias("score"))
    return means.where(F.col("score") > overall)


def scored_activity(spark, folder, method: str) -> DataFrame:
    return pw.pathway_activity(expression(spark, folder), cells(spark, folder), type_sets(spark, folder),
                               genes=genes(spark, folder), method=method)


def scaled_activity(spark, folder, values: DataFrame | None = None) -> DataFrame:
    return pw.robust_activity(pw.pathway_activity(
        expression(spark, folder) if values is None else values, cells(spark, folder), type_sets(spark, folder), genes=genes(spark, folder),
        method="weighted_sum", normalize=False))


def retained_points(spark, folder, values: DataFrame | None = None):
    return pw.activity_points(cells(spark, folder), scaled_activity(spark, folder, values))


def brand_topology(spark, folder):
    values = written(expression(spark, folder))
    return pathway_topology(cells(spark, folder), values, type_sets(spark, folder), topology=derived_topology(spark, folder, values),
                            structure=detected_map(spark, folder))


def holey_matrix(spark, folder) -> DataFrame:
    """The embeddings' matrix with every entry above its diagonal by two or more places missing."""
    matrix = mx.searcher_findee(vectors(spark, folder))
    gap = F.col("target").cast("int") - F.col("source").cast("int")
    return matrix.withColumn("value", F.when(gap < 2, F.col("value")))


def weighted_cells(spark, folder) -> DataFrame:
    """Customers weighted by their balance less 5000, so that many weights are negative."""
    return cells(spark, folder).withColumn("weight", F.col("x") - 50)


def region_matrices(spark, folder) -> DataFrame:
    return written(sm.sample_matrices(sampled_cells(spark, folder), "sample", min_points=100))


def _map(method: str, axis: str = "row") -> Query:
    return lambda s, d: rounded(st.structure_map(mx.searcher_findee(vectors(s, d)), method=method, axis=axis))


def _aggregate(method: str) -> Query:
    return lambda s, d: rounded(pw.gene_aggregate(derived_topology(s, d), type_sets(s, d), aggregate=method))


def _binned(operator, gene: str = "p_type", **options) -> Query:
    return lambda s, d: rounded(operator(expression(s, d, gene), cells(s, d), **options))


def _cluster_rates(s, d) -> DataFrame:
    orders = table(s, d, "orders")
    urgent = orders.where(F.col("o_orderpriority") == "1-URGENT").groupBy(F.col("o_custkey").alias("Barcode")).agg(
        F.max("o_orderstatus").alias("Cluster"))
    big = orders.where(F.col("o_totalprice") > 400000).groupBy(F.col("o_custkey").alias("barcode")).agg(
        F.max("o_orderpriority").alias("cluster"))
    return rounded(sm.map_clusters(cells(s, d), {"urgent": urgent, "big": big})[1])


def _selection(s, d) -> DataFrame:
    return table(s, d, "orders").where(F.col("o_totalprice") > 450000).select(
        F.col("o_custkey").cast("string").alias("Cell ID"))


def _rank_sum(s, d) -> DataFrame:
    values = cells(s, d).select("celltype", F.col("x").alias("value"), F.when(
        F.col("y") < 12, "low").otherwise("other").alias("outcome"))
    return rounded(sm.rank_sum(values, ["celltype"]))


def _staged(s, d) -> DataFrame:
    """Regions A... are the early stage, the others the late one; the early one lacks one label, the late one a pair."""
    matrices = region_matrices(s, d).withColumn("stage", F.when(F.col("sample") < "B", "early").otherwise("late"))
    gone = (F.col("stage") == "early") & ((F.col("source") == "BUILDING") | (F.col("target") == "BUILDING"))
    return matrices.where(~gone & ~((F.col("stage") == "late") & (F.col("source") == "MACHINERY") & (F.col("target") == "FURNITURE")))


def _stage_drift(s, d) -> DataFrame:
    means = written(_staged(s, d).groupBy("stage", "source", "target").agg(F.avg("value").alias("value")))
    return rounded(mx.drift(means.where("stage = 'early'").drop("stage"), means.where("stage = 'late'").drop("stage"))[0])


def _label_pairs(s, d) -> DataFrame:
    return rounded(sm.label_pairs(sm.sample_structure_maps(sampled_cells(s, d), "sample", min_points=100), ["sample"]))


def some_genes(spark, folder) -> DataFrame:
    return genes(spark, folder).where(F.col("gene") < "Brand#3")


def _drift(s, d) -> DataFrame:
    matrices = region_matrices(s, d)
    first = matrices.where(F.col("sample") == matrices.agg(F.min("sample")).scalar()).drop("sample")
    last = matrices.where(F.col("sample") == matrices.agg(F.max("sample")).scalar()).drop("sample")
    return rounded(mx.drift(first, last)[1])


def given_sizes(spark, folder) -> DataFrame:
    """Percentages for every pair of labels: each customer label's share of customers with a balance above the other's mean."""
    means = cells(spark, folder).groupBy(F.col("celltype").alias("col")).agg(F.avg("x").alias("mean"))
    return cells(spark, folder).join(means, F.lit(True)).groupBy(F.col("celltype").alias("row"), "col").agg(
        (F.avg((F.col("x") > F.col("mean")).cast("double")) * 150).alias("value"))


def _pathway_hotspots(s, d) -> DataFrame:
    activity = written(scaled_activity(s, d))
    diagnostics = activity.groupBy("pathway").agg(
        F.max("value").alias("retained_quantile"), F.count("*").alias("retained_cell_count"), F.lit("all").alias("activity_mode"))
    to_cell = pw.gene_aggregate(derived_topology(s, d), type_sets(s, d))
    return rounded(pw.pathway_hotspots(cells(s, d), activity, to_cell, diagnostics, q=0.9))


def owned_transcripts(spark, folder) -> DataFrame:
    """Order lines as molecules that lie in their customer's cell."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    kinds = table(spark, folder, "part").select("p_partkey", F.col("p_type").alias("feature_name"))
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("cell_id"))
    return lines.join(kinds, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def _hotspots(s, d) -> DataFrame:
    values = written(expression(s, d))
    return rounded(ia.hotspots(brand_scores(s, d, values), values, cells(s, d)))


def _mode_summary(s, d) -> DataFrame:
    values = written(expression(s, d))
    topology = written(derived_topology(s, d, values))
    aggregate = pw.gene_aggregate(topology, type_sets(s, d))
    mean = pw.gene_aggregate(topology, type_sets(s, d), aggregate="mean")
    points, diagnostics = retained_points(s, d, values)
    return rounded(pw.mode_comparison(aggregate, mean, diagnostics, primary="gene_topology_aggregate",
                                      structure_source="precomputed"))


def _batch_sums(spark, folder) -> DataFrame:
    """Sums of two batches of sources that are all customers together, added up."""
    batches = [partial_sums(weighted_cells(spark, folder).where(part), cells(spark, folder)) for part in ("weight < 0", "not (weight < 0)")]
    return rounded(batches[0].unionByName(batches[1]).groupBy("source", "target").agg(F.sum("total").alias("total"), F.sum("n").alias("n")))


def _arriving_targets(spark, folder) -> DataFrame:
    """Matrix of all customers after all of them have arrived as targets, in three batches."""
    places = written(source_places(cells(spark, folder)))
    state = None
    for part in ("x < 20", "x >= 20 and x < 60", "not (x < 60)"):
        found = closer_places(places, cells(spark, folder).where(part), state)
        state = written(found if state is None else state.unionByName(found))
    return rounded(matrix_of_closest(places, state))


QUERIES: dict[str, Query] = {
    "searcher_findee_2d": lambda s, d: rounded(mx.searcher_findee(vectors(s, d))),
    "searcher_findee_3d": lambda s, d: rounded(mx.searcher_findee(vectors(s, d), z_col="z")),
    "searcher_findee_brand": lambda s, d: rounded(mx.searcher_findee(parts(s, d))),
    "searcher_findee_segment": lambda s, d: rounded(mx.searcher_findee(cells(s, d))),
    "nearest_label_per_point": lambda s, d: rounded(mx.nearest_label_table(vectors(s, d), "cell_id")),
    "profile_distance_rows": lambda s, d: rounded(st.profile_distances(mx.searcher_findee(vectors(s, d)))),
    "profile_distance_cols": lambda s, d: rounded(st.profile_distances(mx.searcher_findee(vectors(s, d)), "col")),
    "structure_map_row": _map("average"),
    "structure_map_col": _map("average", "col"),
    "structure_map_single": _map("single"),
    "structure_map_complete": _map("complete"),
    "structure_map_weighted": _map("weighted"),
    "structure_map_ward": _map("ward"),
    "structure_map_centroid": _map("centroid"),
    "structure_map_median": _map("median"),
    "structure_map_brand": lambda s, d: rounded(st.structure_map(mx.searcher_findee(parts(s, d)))),
    "cophenetic_correlation": lambda s, d: rounded(st.cophenetic_correlation(mx.searcher_findee(vectors(s, d)))),
    "group_mean_cophenetic": lambda s, d: rounded(st.cophenetic_from_mean_matrix(holey_matrix(s, d))),
    "dendrogram_scores": lambda s, d: rounded(st.dendrogram(mx.searcher_findee(vectors(s, d)))),
    "leaf_positions": lambda s, d: st.leaf_positions(mx.searcher_findee(parts(s, d))),
    "newick_tree": lambda s, d: st.newick(mx.searcher_findee(parts(s, d))).select("newick"),
    "finite_block": lambda s, d: rounded(mx.finite_block(holey_matrix(s, d))),
    "weighted_searcher_findee": lambda s, d: rounded(mx.weighted_searcher_findee(weighted_cells(s, d))),
    "weighted_structure_map": lambda s, d: rounded(st.structure_map(mx.weighted_searcher_findee(
        weighted_cells(s, d), min_weight=10.0))),
    "two_table_distance": lambda s, d: rounded(mx.between_tables(cells(s, d), located_suppliers(s, d))),
    "split_by_distance": lambda s, d: nb.split_by_distance(cells(s, d), "BUILDING", "MACHINERY").select(
        "cell_id", F.col("split_MACHINERY_by_BUILDING_in_celltype").alias("label")),
    "knn_edges": lambda s, d: nb.neighbor_edges(vectors(s, d), k_neighbors=8),
    "radius_edges": lambda s, d: rounded(nb.radius_edges(parts(s, d), 0.25)),
    "nn_scale": lambda s, d: rounded(nb.spacing(vectors(s, d), id_col="cell_id")),
    "niche_smooth": lambda s, d: rounded(nb.smooth(
        expression(s, d), nb.neighbor_edges(cells(s, d), k_neighbors=6), places=cells(s, d))),
    "label_enrichment": lambda s, d: rounded(en.radius_enrichment(parts(s, d), 0.25)),
    "label_proximity": lambda s, d: rounded(en.proximity(en.label_enrichment(cells(s, d), nb.neighbor_edges(cells(s, d), k_neighbors=6)))),
    "enrichment_sweep": lambda s, d: rounded(en.enrichment_sweep(cells(s, d), neighbors=(4, 6, 8), radii=(0.5, 1.5))),
    "wmda": _binned(binned.wmda, "p_brand"),
    "ewnn": _binned(binned.ewnn, "p_brand", threshold=120.0),
    "visium_distance": _binned(binned.visium),
    "visium_mean_directed": _binned(binned.visium, agg="mean", symmetric="none"),
    "visium_unweighted": _binned(binned.visium, agg="median", weight_by_expression=False, symmetric="mean"),
    "nn_weighted_gene": _binned(binned.weighted_nearest),
    "expression_summary": lambda s, d: rounded(ex.summarize_by_celltype(expression(s, d), cells(s, d))),
    "expression_rank": lambda s, d: rounded(ex.ranks(expression(s, d), cells(s, d), genes(s, d))),
    "rank_label_means": lambda s, d: rounded(ex.sparse_ranks(expression(s, d), cells(s, d), genes(s, d)).mean_by_label(
        cells(s, d), genes(s, d))),
    "normalized_label_means": lambda s, d: rounded(ex.sparse_log_scale(expression(s, d), cells(s, d), genes(s, d)).mean_by_label(
        cells(s, d), genes(s, d))),
    "normalize_log_scale": lambda s, d: rounded(ex.normalize_log_scale(
        event_expression(s, d), event_expression(s, d).select("cell_id").distinct(),
        event_expression(s, d).select("gene").distinct())),
    "counts_per_gene": lambda s, d: rounded(ex.counts_per_gene(expression(s, d))),
    "entity_points": lambda s, d: rounded(entity.entity_points(
        cells(s, d), expression(s, d, "p_type").withColumn("value", F.col("value") - 60))),
    "entity_to_cell": lambda s, d: rounded(entity.entity_to_cell(
        cells(s, d), entity.entity_points(cells(s, d), expression(s, d, "p_type"), min_weight=0.0))),
    "entity_structuremap": lambda s, d: rounded(entity.entity_structuremap(
        entity.entity_points(cells(s, d), expression(s, d, "p_type")))),
    "transcript_by_cell": lambda s, d: rounded(entity.transcript_to_cell(cells(s, d), transcripts(s, d))[1]),
    "transcript_by_cell_counts": lambda s, d: rounded(counts_by_group(owned_transcripts(s, d), cells(s, d).where("celltype < 'H'"))),
    "batch_sums": _batch_sums,
    "arriving_targets": _arriving_targets,
    "circle_data": lambda s, d: rounded(figures.circle_data(
        st.structure_map(mx.searcher_findee(cells(s, d))), given_sizes(s, d), exponent=0.5, max_area=100)),
    "pathway_hotspots": _pathway_hotspots,
    "lr_contact": lambda s, d: rounded(brand_contact(s, d)),
    "lr_scores": lambda s, d: rounded(brand_scores(s, d)),
    "lr_top_pairs": lambda s, d: rounded(ia.top_pairs(brand_scores(s, d), 12)),
    "lr_summary_matrix": lambda s, d: rounded(ia.summary_matrix(brand_scores(s, d), 12)),
    "lr_hotspots": _hotspots,
    "lr_target_consistency": lambda s, d: rounded(ia.target_consistency(
        brand_scores(s, d), receiver_signatures(s, d), target_prior(s, d)).select(
        "pair_id", "sender_celltype", "receiver_celltype", "target_support", "topology_and_target_supported")),
    "lr_scores_recomputed": lambda s, d: rounded(recomputed_scores(s, d)),
    "pathway_activity_rank": lambda s, d: rounded(scored_activity(s, d, "rank_mean")),
    "pathway_activity_sum": lambda s, d: rounded(scored_activity(s, d, "weighted_sum")),
    "pathway_activity_scaled": lambda s, d: rounded(scaled_activity(s, d)),
    "pathway_activity_smoothed": lambda s, d: rounded(niche_smoothed(
        scaled_activity(s, d), nb.neighbor_edges(cells(s, d), k_neighbors=6), cells(s, d))),
    "pathway_gene_median": _aggregate("weighted_median"),
    "pathway_gene_trimmed": _aggregate("weighted_trimmed_mean"),
    "pathway_gene_mean": _aggregate("mean"),
    "pathway_points": lambda s, d: rounded(retained_points(s, d)[0]),
    "pathway_points_highest": lambda s, d: rounded(pw.activity_points(
        cells(s, d), expression(s, d).withColumnRenamed("gene", "pathway"), schedule=(0.9999,), min_cells=60)[0]),
    "pathway_diagnostics": lambda s, d: rounded(retained_points(s, d)[1]),
    "pathway_mode_summary": _mode_summary,
    "pathway_topology_activity": lambda s, d: rounded(brand_topology(s, d).pathway_activity_to_cell),
    "pathway_topology_structuremap": lambda s, d: rounded(brand_topology(s, d).pathway_structuremap),
    "cluster_merge_hit_rate": _cluster_rates,
    "sample_matrices": lambda s, d: rounded(region_matrices(s, d)),
    "sample_structure_maps": lambda s, d: rounded(sm.sample_structure_maps(sampled_cells(s, d), "sample", min_points=100)),
    "sample_mean_matrix": lambda s, d: rounded(mx.mean_matrix(region_matrices(s, d), "sample")),
    "sample_drift": _drift,
    "stage_mean": lambda s, d: rounded(mx.stage_mean(_staged(s, d), "stage")),
    "stage_drift": _stage_drift,
    "label_pairs": _label_pairs,
    "expression_rank_subset": lambda s, d: rounded(ex.ranks(expression(s, d), cells(s, d), some_genes(s, d))),
    "pathway_activity_rank_subset": lambda s, d: rounded(pw.pathway_activity(
        expression(s, d), cells(s, d), type_sets(s, d), genes=some_genes(s, d), method="rank_mean")),
    "rank_sum": _rank_sum,
    "selection_filter": lambda s, d: rounded(sm.selected(cells(s, d), _selection(s, d))),
    "landmark_union": lambda s, d: rounded(mx.searcher_findee(sm.with_landmark(cells(s, d), _selection(s, d)))),
}
