"""Readers for cell tables, expression matrices, transcripts, cluster files and spot positions.

HDF5 and zarr containers have no Spark reader; convert them once to parquet or to the text matrix
format (barcodes, features, matrix) and read that.
"""

from __future__ import annotations

from dataclasses import dataclass
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelscape.functions.normalize import number
from labelscape.operators.expression import Filled, normalize_log_scale, sparse_log_scale
from labelscape.operators.samples import map_clusters, single_labels
from labelscape.sources import files
from labelscape.sources.points import first_present, require
from labelscape.sources.sinks import read_lines

# Column names and patterns of the file formats read here.
COORDINATE_COLUMNS = (
    ("x_centroid", "y_centroid"), ("cell_x_centroid", "cell_y_centroid"), ("cell_centroid_x", "cell_centroid_y"),
    ("centroid_x", "centroid_y"), ("x", "y"))
CLUSTER_COLUMNS = ("Cluster", "cluster", "Clusters")
FEATURE_COLUMNS = ("feature_name", "gene_name", "gene_identity")
CONTROL_FEATURES = "NegControl|Unassigned"
POSITION_COLUMNS = {
    "array_row": ("row", "array_y", "grid_y", "spot_row"),
    "array_col": ("col", "array_x", "grid_x", "spot_col"),
    "pxl_col_in_fullres": ("pxl_x", "pxl_col", "x", "image_x"),
    "pxl_row_in_fullres": ("pxl_y", "pxl_row", "y", "image_y"),
    "in_tissue": ("inTissue", "intissue", "in_tissue_flag", "is_tissue"),
}
TOPOLOGY_FILES = ("t_and_c_result*.csv", "*t_and_c*.csv")
STRUCTURE_FILES = ("StructureMap_table*.csv", "*StructureMap*.csv")


@dataclass
class CellBundle:
    """cells: cell_id, x, y, Cluster and the file's other columns; genes: gene, name; long expression.

    ``filled``, where asked for: the normalised expression without rows for absent values.
    """

    cells: DataFrame
    genes: DataFrame | None = None
    expression: DataFrame | None = None
    raw: DataFrame | None = None
    filled: Filled | None = None


def bundle_path(spark: SparkSession, folder: str, given: str | None, pattern: str) -> str:
    return files.only(spark, folder, pattern) if given is None else str(given)


def coerce_cells(cells: DataFrame, *, cluster_col: str | None = None, cell_id_col: str = "cell_id") -> DataFrame:
    """Text ``cell_id``, numeric ``x`` and ``y``, and ``Cluster`` (NULL without a cluster column)."""
    require(cells, [cell_id_col], "cells")
    axes = next((p for p in COORDINATE_COLUMNS if set(p) <= set(cells.columns)), None)
    if axes is None:
        raise ValueError("cell coordinates were not found")
    prefixed = [c for c in cells.columns if c.startswith("cluster__")]
    cluster = first_present(cells, [*([cluster_col] if cluster_col else []), *CLUSTER_COLUMNS, *prefixed])
    label = F.col(cluster).cast("string") if cluster else F.lit(None).cast("string")
    return cells.withColumns({
        "cell_id": F.col(cell_id_col).cast("string"), "x": F.col(axes[0]).cast("double"),
        "y": F.col(axes[1]).cast("double"), "Cluster": label})


def read_text_matrix(spark: SparkSession, folder: str, *, gene_expression_only: bool = False) -> DataFrame:
    """(cell_id, gene, value) from barcodes, features and matrix text files, plain or gzipped.

    The matrix names cells and genes by line number of the two name lists.
    """
    def lines(name: str) -> DataFrame:
        return numbered_lines(spark.read.text(bundle_path(spark, folder, None, f"{name}*")))

    cells = lines("barcodes").select(F.col("line").alias("_c"), F.split("value", "\t")[0].alias("cell_id"))
    parts = F.split("value", "\t")
    genes = lines("features").select(F.col("line").alias("_g"), F.coalesce(F.get(parts, F.lit(1)), parts[0]).alias("gene"),
                                     F.get(parts, F.lit(2)).alias("kind"))
    if gene_expression_only:
        genes = genes.where(F.col("kind").isNull() | (F.col("kind") == "Gene Expression"))
    matrix = spark.read.text(bundle_path(spark, folder, None, "matrix*")).where(~F.col("value").startswith("%"))
    entry = F.split(F.trim("value"), r"\s+")
    # the first line after the comments only holds the sizes
    entries = numbered_lines(matrix).where("line > 1").select(
        entry[0].cast("long").alias("_g"), entry[1].cast("long").alias("_c"), entry[2].cast("double").alias("value"))
    return entries.join(genes.select("_g", "gene"), "_g").join(cells, "_c").groupBy("cell_id", "gene").agg(
        F.sum("value").alias("value"))


def numbered_lines(text: DataFrame) -> DataFrame:
    """Lines of one text file with their 1-based ``line`` number, also when the file is read in many splits."""
    rows = text.select("value", F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_id"))
    blocks = rows.groupBy("_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("_before", F.coalesce(before, F.lit(0)))
    return rows.join(blocks, "_block").select(
        "value", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"))


def read_expression(spark: SparkSession, path: str) -> DataFrame:
    """(cell_id, gene, value): a long parquet table or a text-matrix folder."""
    if path.endswith(".h5"):
        raise NotImplementedError("HDF5 has no Spark reader; convert it to parquet or a text matrix first")
    if files.listed(spark, path, "matrix*"):
        return read_text_matrix(spark, path)
    return spark.read.parquet(path).select(F.col("cell_id").cast("string"), F.col("gene").cast("string"),
                                           F.col("value").cast("double"))


def load_table_bundle(spark: SparkSession, folder: str, *, cells_path: str | None = None,
                      cell_groups_path: str | None = None, feature_matrix_path: str | None = None,
                      normalize: bool = False, cluster_col: str = "Clusters", cell_id_col: str = "Barcode") -> CellBundle:
    """Cells joined with their group file, and the expression matrix."""
    cells = spark.read.parquet(bundle_path(spark, folder, cells_path, "cells.parquet"))
    groups = spark.read.csv(bundle_path(spark, folder, cell_groups_path, "*_cell_groups.csv"), header=True)
    require(groups, [cell_id_col, cluster_col], "cell groups")
    own_id = cell_id_col if cell_id_col in cells.columns else "cell_id"
    groups = single_labels(groups, cell_id_col, cluster_col, cluster_col)
    joined = cells.drop(cluster_col).join(groups, F.col(own_id).cast("string") == F.col("_id"), "left").drop("_id")
    matrix = bundle_path(spark, folder, feature_matrix_path, "cell_feature_matrix*")
    return _bundle(coerce_cells(joined, cluster_col=cluster_col, cell_id_col=own_id), read_expression(spark, matrix), normalize)


def load_cells(spark: SparkSession, folder: str, *, normalize: bool = True, sparse: bool = False) -> CellBundle:
    """Cells with any cluster column they carry, and the expression matrix; with ``sparse`` its normalised form is ``filled``."""
    cells = coerce_cells(spark.read.parquet(f"{folder}/cells.parquet"), cluster_col="cluster")
    return _bundle(cells, read_expression(spark, bundle_path(spark, folder, None, "cell_feature_matrix*")), normalize, sparse)


def _bundle(cells: DataFrame, expression: DataFrame, normalize: bool, sparse: bool = False) -> CellBundle:
    names = expression.select("gene").distinct()
    if normalize and sparse:
        filled = sparse_log_scale(expression, cells, names)
        return CellBundle(cells=cells, genes=names.withColumn("name", F.col("gene")), expression=filled.rows, raw=expression, filled=filled)
    scaled = normalize_log_scale(expression, cells, names) if normalize else expression
    return CellBundle(cells=cells, genes=names.withColumn("name", F.col("gene")), expression=scaled, raw=expression)


def gene_names(genes: DataFrame) -> DataFrame:
    """(gene): the ``name`` column where there is one, else the id."""
    name = F.coalesce("name", "gene") if "name" in genes.columns else F.col("gene")
    return genes.select(name.cast("string").alias("gene"))


def transcript_points(coords: DataFrame, *, min_quality: float | None = None) -> DataFrame:
    """(x, y, feature_name, cell_id) without control and unassigned features."""
    feature = first_present(coords, list(FEATURE_COLUMNS))
    if feature is None:
        raise ValueError(f"transcripts need one of the columns {FEATURE_COLUMNS}")
    axes = next((p for p in (("x", "y"), ("x_location", "y_location")) if set(p) <= set(coords.columns)), None)
    if axes is None:
        raise ValueError("transcripts need x and y columns")
    if min_quality is not None:
        quality = first_present(coords, ["qv", "quality_score"])
        coords = coords.where(F.col(quality) >= min_quality)
    cell = F.col("cell_id").cast("string") if "cell_id" in coords.columns else F.lit(None).cast("string")
    return coords.where(~F.col(feature).cast("string").rlike(CONTROL_FEATURES)).select(
        F.col(axes[0]).cast("double").alias("x"), F.col(axes[1]).cast("double").alias("y"),
        F.col(feature).cast("string").alias("feature_name"), cell.alias("cell_id"))


def load_transcripts(spark: SparkSession, folder: str, **options) -> DataFrame:
    path = f"{folder}/transcripts.parquet"
    if not files.exists(spark, path):
        raise ValueError(f"{path} is absent")
    return transcript_points(spark.read.parquet(path), **options)


def location_columns(df: DataFrame) -> DataFrame:
    """Rename x, y, z and gene to x_location, y_location, z_location and feature_name where absent."""
    for old, new in (("x", "x_location"), ("y", "y_location"), ("z", "z_location"), ("gene", "feature_name")):
        if new not in df.columns and old in df.columns:
            df = df.withColumnRenamed(old, new)
    for needed in ("x_location", "y_location"):
        if needed not in df.columns:
            raise KeyError(needed)
    return df


#: What the clustering folders are called, and what their columns are called.
CLUSTER_FOLDERS = (
    (r".*graphclust.*", "xoa_graphclust"), (r"(?:.*_)?kmeans.*?_(\d+)(?:_.*)?", r"xoa_kmeans_\1"), (r".*kmeans.*", "xoa_kmeans"),
    (r"(?:gene_expression_)?(.*?)(?:_clusters)?", r"xoa_\1"),
)


def cluster_column(directory: str) -> str:
    """Column name for the clusters.csv of one clustering folder: the first rule that fits its name."""
    name = directory.lower()
    return next(re.sub(f"^{rule}$", column, name) for rule, column in CLUSTER_FOLDERS if re.fullmatch(rule, name))


def merge_clusters(cells: DataFrame, folder: str, *, clustering_root: str = "analysis/clustering", id_col: str = "cell_id",
                   barcode_col: str = "Barcode", cluster_col: str = "Cluster",
                   label_ids: DataFrame | None = None) -> tuple[DataFrame, list[str], DataFrame]:
    """Every clusters.csv below the root as a column: (cells, new columns, hit rates).

    ``label_ids`` (label_id, cell_id) is for cells known by a number, as segmentation masks have them: ``id_col`` then holds label
    ids, whole numbers that may have become text like "12.0", and the table leads to the barcodes.
    """
    spark = cells.sparkSession
    found = files.below(spark, f"{folder}/{clustering_root}", "clusters.csv")
    if not found:
        raise FileNotFoundError(f"{folder}/{clustering_root} holds no clusters.csv")
    tables = {cluster_column(f.split("/")[-2]): spark.read.csv(f, header=True) for f in found}
    own = id_col
    if label_ids is not None:
        own = "_barcode"
        lookup = single_labels(label_ids.select(whole_number("label_id").alias("label_id"), "cell_id"), "label_id", "cell_id", own)
        cells = cells.join(lookup, whole_number(id_col) == F.col("_id"), "left").drop("_id")
    merged, rates = map_clusters(cells, tables, id_col=own, barcode_col=barcode_col, cluster_col=cluster_col)
    return merged.drop("_barcode"), list(tables), rates


def whole_number(column: str) -> F.Column:
    """Text of an id without a trailing ``.0``."""
    return F.regexp_replace(F.trim(F.col(column).cast("string")), r"\.0+$", "")


def read_spot_bundle(spark: SparkSession, base: str, *, use_filtered: bool = True, counts: bool = True) -> CellBundle:
    """Spot positions and counts; positions go under standard names, absent ones become 0. ``counts=False`` reads positions only."""
    path = f"{base}/spatial/tissue_positions.parquet"
    if not files.exists(spark, path):
        raise FileNotFoundError(f"{path} is absent")
    spots = spark.read.parquet(path)
    require(spots, ["barcode"], "positions")
    for name, others in POSITION_COLUMNS.items():
        found = name if name in spots.columns else first_present(spots, list(others))
        spots = spots.withColumn(name, F.col(found) if found else F.lit(0))
    spots = spots.select(F.col("barcode").cast("string").alias("cell_id"), *POSITION_COLUMNS).withColumns({
        "x": F.col("pxl_col_in_fullres").cast("double"), "y": F.col("pxl_row_in_fullres").cast("double")})
    kind = "filtered" if use_filtered else "raw"
    expression = None
    if counts:
        found = files.listed(spark, base, f"{kind}_feature_bc_matrix*")
        if not found:
            raise FileNotFoundError(f"nothing at {base}/{kind}_feature_bc_matrix*")
        # an HDF5 file alone is an error that read_expression states
        expression = read_expression(spark, next((p for p in found if not p.endswith(".h5")), found[0]))
    return CellBundle(cells=spots, expression=expression, raw=expression)


def read_points_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False)


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """A cell selection: comment lines, then ``Cell ID`` and further columns."""
    return spark.read.csv(path, header=True, comment="#")


def read_matrix_csv(spark: SparkSession, path: str, *, row: str = "row", column: str = "col") -> DataFrame:
    """Wide labelled matrix file as a long table; the first column holds the row labels."""
    return read_lines(spark, path, row=row, column=column).withColumn("value", number(F.col("value"), None))


def precomputed_tables(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(gene topology, structure map) from a result file or folder, first match by name each."""
    is_file = path.endswith(".csv") and not files.listed(spark, path, "*")
    folder = path.rpartition("/")[0] or "." if is_file else path

    def pick(patterns) -> str | None:
        return next((found[0] for p in patterns if (found := files.listed(spark, folder, p))), None)

    topology, structure = path if is_file else pick(TOPOLOGY_FILES), pick(STRUCTURE_FILES)
    return (read_matrix_csv(spark, topology, row="gene", column="celltype") if topology else None,
            read_matrix_csv(spark, structure) if structure else None)
