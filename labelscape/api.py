"""The public calls under the names users of pandas-based spatial topology tools know.

All take and return Spark DataFrames; matrices are long (source, target, value) or (row, col, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from labelscape.operators import binned, entity, interaction, matrices, neighbors, pathway, structure
from labelscape.operators.expression import summarize_by_celltype as summarize_expression_by_celltype  # noqa: F401
from labelscape.plans.interaction import ligand_receptor_topology as ligand_receptor_topology_analysis  # noqa: F401
from labelscape.plans import transcripts
from labelscape.plans.pathway import pathway_topology as pathway_topology_analysis  # noqa: F401
from labelscape.render import figures
from labelscape.session import written
from labelscape.sources import bundles

load_xenium_data = bundles.load_cells
load_xenium_table_bundle = bundles.load_table_bundle
load_xenium_transcripts = bundles.load_transcripts
read_visium_bin = bundles.read_spot_bundle
merge_xenium_clusters_into_adata = bundles.merge_clusters

compute_searcher_findee_distance_matrix_from_df = matrices.searcher_findee
compute_weighted_searcher_findee_distance_matrix_from_df = matrices.weighted_searcher_findee
compute_groupwise_average_distance_between_two_dfs = matrices.between_tables
split_B_by_distance_to_A = neighbors.split_by_distance

calculate_gene_distance_matrix_ewnn = binned.ewnn
calculate_gene_distance_matrix_wmda = binned.wmda
calculate_gene_distance_matrix_visium = binned.visium
calculate_gene_distance_matrix_ewnn_gpu = binned.weighted_nearest
calculate_gene_distance_matrix_wmda_gpu = binned.wmda

build_entity_points_from_expression = entity.entity_points
compute_entity_to_cell_topology = entity.entity_to_cell
compute_entity_structuremap = entity.entity_structuremap
transcript_by_cell_analysis = transcripts.transcript_by_cell
transcript_by_cell_analysis_serial = transcripts.transcript_by_cell

compute_pathway_activity_matrix = pathway.pathway_activity
ligand_receptor_target_consistency = interaction.target_consistency

plot_cophenetic_heatmap = figures.draw_heatmap
circle_heatmap = figures.circle_data
plot_circular_dendrogram_pycirclize = figures.tree_text


def compute_cophenetic_from_distance_matrix(matrix: DataFrame, method: str = "average") -> tuple[DataFrame, DataFrame]:
    """(row map, column map) of a label matrix, which is evaluated once for both."""
    matrix = written(matrix)
    return (structure.structure_map(matrix, method=method),
            structure.structure_map(matrix, method=method, axis="col"))


def compute_cophenetic_distances_from_df(points: DataFrame, *, method: str = "average", **columns) -> tuple[DataFrame, DataFrame]:
    """(row map, column map) of a point table."""
    if points.isEmpty():
        raise ValueError("the point table is empty")
    return compute_cophenetic_from_distance_matrix(matrices.searcher_findee(points, **columns), method)


compute_cophenetic_distances_from_df_memory_opt = compute_cophenetic_distances_from_df


def compute_cophenetic_distances_from_adata(points: DataFrame, id_col: str = "cell_id", *, method: str = "average",
                                            **columns) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row map, column map, nearest-label table of every point)."""
    near = matrices.nearest_label_table(points, id_col, **columns)
    return *compute_cophenetic_distances_from_df(points, method=method, **columns), near


def compute_weighted_cophenetic_distances_from_df(points: DataFrame, *, method: str = "average", **columns) -> tuple[DataFrame, DataFrame]:
    return compute_cophenetic_from_distance_matrix(matrices.weighted_searcher_findee(points, **columns), method)


def compute_cophenetic_distances_from_group_mean_matrix(matrix: DataFrame, method: str = "average", metric: str = "euclidean",
                                                        normalize: bool = True) -> tuple[DataFrame, DataFrame]:
    return tuple(structure.cophenetic_from_mean_matrix(matrix, method=method, metric=metric, normalize=normalize, axis=axis)
                 for axis in ("row", "col"))


def compute_col_dendrogram_scores(points: DataFrame, *, method: str = "average", **columns) -> dict:
    """Nested tree of the labels with split scores."""
    return structure.dendrogram_dict(structure.dendrogram(matrices.searcher_findee(points, **columns), method=method))


def generate_cluster_distance_heatmap_from_df(points: DataFrame, **columns) -> DataFrame:
    """Plain distance matrix in clustered order, ready to draw."""
    return figures.heatmap_data(written(matrices.searcher_findee(points, **columns)), row="source", col="target")


generate_cluster_distance_heatmap_from_adata = generate_cluster_distance_heatmap_from_df


def generate_cluster_distance_heatmap_from_path(spark, folder: str, **columns) -> DataFrame:
    return generate_cluster_distance_heatmap_from_df(
        bundles.load_cells(spark, folder, normalize=False).cells, celltype_col="Cluster", **columns)


def generate_TCR_distance_heatmap_from_df(points: DataFrame, *, dropna_axis: str = "both", **columns) -> DataFrame | None:
    """Finite block of the distance matrix in clustered order; None with fewer than two rows or columns."""
    block = written(matrices.finite_block(matrices.searcher_findee(points, **columns), dropna_axis=dropna_axis))
    if block.select("source").distinct().count() < 2 or block.select("target").distinct().count() < 2:
        return None
    return figures.heatmap_data(block, row="source", col="target")
