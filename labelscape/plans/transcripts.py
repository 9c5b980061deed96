"""Transcripts against cells, from a folder to result files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscape.operators.entity import transcript_to_cell
from labelscape.session import written
from labelscape.sources.bundles import gene_names, load_cells, load_transcripts
from labelscape.sources.points import require
from labelscape.sources.sinks import write_matrix_csv, write_table


@dataclass
class TranscriptResult:
    """structure: map of the labels; topology: (gene, celltype, value); counts: (gene, celltype, count) of the transcripts' own cells."""

    structure: DataFrame
    topology: DataFrame
    counts: DataFrame
    files: dict[str, str] = field(default_factory=dict)


def counts_by_group(transcripts: DataFrame, cells: DataFrame) -> DataFrame:
    """(gene, celltype, count): transcripts per gene and label of the cell they lie in; without a labelled cell the label is NULL."""
    own = cells.select(F.col("cell_id").cast("string").alias("cell_id"), "celltype").where("cell_id is not null")
    counts = transcripts.groupBy(F.col("cell_id").cast("string").alias("cell_id"), F.col("feature_name").alias("gene")).count()
    return counts.join(own, "cell_id", "left").groupBy("gene", "celltype").agg(F.sum("count").alias("count"))


def grouped_cells(cells: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(cell_id, x, y, celltype): labels from a table of (cell_id, group), or else the cells' own clusters."""
    if groups is None:
        return cells.select("cell_id", "x", "y", F.col("Cluster").alias("celltype"))
    require(groups, ["cell_id", "group"], "groups")
    lookup = groups.select(F.col("cell_id").cast("string").alias("cell_id"), F.col("group").cast("string").alias("celltype"))
    return cells.select("cell_id", "x", "y").join(lookup, "cell_id", "left")


def transcript_by_cell(spark: SparkSession, folder: str, *, sample_name: str | None = None, output_folder: str | None = None,
                       groups: DataFrame | None = None, method: str = "average", strategy: str = "auto") -> TranscriptResult:
    """Place every gene's transcripts relative to the cells' labels and write the tables next to each other.

    Genes are those of the expression matrix. ``output_folder`` gets the structure map and the topology as wide files and the counts as a
    long one; without it nothing is written.
    """
    sample = sample_name or folder.rstrip("/").rpartition("/")[2]
    bundle = load_cells(spark, folder, normalize=False)
    cells = written(grouped_cells(bundle.cells, groups))
    transcripts = written(load_transcripts(spark, folder))
    structure, topology = transcript_to_cell(cells, transcripts, genes=gene_names(bundle.genes), method=method, strategy=strategy)
    result = TranscriptResult(structure, written(topology), counts_by_group(transcripts, cells))
    if output_folder is not None:
        result.files = {
            "structure": write_matrix_csv(structure, f"{output_folder}/StructureMap_table_{sample}.csv", "row", "col"),
            "topology": write_matrix_csv(result.topology, f"{output_folder}/t_and_c_result_{sample}.csv", "gene", "celltype"),
            "counts": write_table(result.counts, f"{output_folder}/counts_{sample}.csv"),
        }
    return result
