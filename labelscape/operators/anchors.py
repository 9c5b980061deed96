"""Gene-to-label anchors: precomputed rows where they exist, everything else recomputed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscape.operators.entity import entity_points, entity_to_cell
from labelscape.operators.matrices import searcher_findee
from labelscape.operators.structure import structure_map
from labelscape.session import written

MODES = ("precomputed", "recompute", "hybrid")


@dataclass
class Anchors:
    """``topology``: gene, celltype, value, source; ``structure``: row, col, value (complete grid)."""

    topology: DataFrame
    structure: DataFrame
    structure_source: str


def resolve_anchors(reference: DataFrame, expression: DataFrame, genes: DataFrame, *,
                    topology: DataFrame | None = None, structure: DataFrame | None = None,
                    provided_structure: DataFrame | None = None, anchor_mode: str = "precomputed",
                    points: DataFrame | None = None, min_weight: float = 0.0, method: str = "average",
                    strategy: str = "auto") -> Anchors:
    """``topology`` is long (gene, celltype, value), ``structure`` long (row, col, value).

    With ``precomputed`` or ``hybrid`` a gene found in ``topology`` keeps its row, all other genes are
    recomputed. A structure map is precomputed, provided or recomputed, in this order; gaps become 1
    and the diagonal 0.
    """
    if anchor_mode not in MODES:
        raise ValueError(f"anchor_mode={anchor_mode!r} is unknown; use one of {MODES}")
    genes = genes.select(F.col(genes.columns[0]).cast("string").alias("gene")).distinct()
    labels = reference.select("celltype").distinct()
    if structure is None:
        structure = provided_structure
    parts, missing = [], genes
    if anchor_mode != "recompute" and topology is not None:
        genes = written(genes)
        known = topology.select(F.col("gene").cast("string"), F.col("celltype").cast("string"),
                                F.col("value").cast("double"), F.lit("precomputed").alias("source"))
        known = written(known.join(genes, "gene", "left_semi"))
        parts.append(known)
        missing = genes.join(known.select("gene").distinct(), "gene", "left_anti")
    if not parts or not missing.isEmpty():
        cloud = points if points is not None else entity_points(
            reference, expression, entities=missing, min_weight=min_weight)
        cloud = cloud.join(missing.withColumnRenamed("gene", "entity"), "entity", "left_semi")
        found = entity_to_cell(reference, cloud, min_weight=min_weight, method=method, strategy=strategy)
        parts.append(found.select(F.col("entity").alias("gene"), "celltype", "value", F.lit("recompute").alias("source")))
    have = parts[0]
    for part in parts[1:]:
        have = have.unionByName(part)
    have = written(have)
    names = labels.agg(F.collect_list("celltype")).scalar()
    grid = genes.select("gene", F.explode(names).alias("celltype"))
    origin = have.select("gene", "source").distinct()
    full = grid.join(have.select("gene", "celltype", "value"), ["gene", "celltype"], "left").join(
        origin, "gene", "left").withColumn("source", F.coalesce("source", F.lit("recompute")))

    if structure is not None and anchor_mode != "recompute":
        chosen, origin_name = structure, "precomputed"
    elif provided_structure is not None:
        chosen, origin_name = provided_structure, "provided"
    else:
        chosen = structure_map(searcher_findee(reference, strategy=strategy), method=method)
        origin_name = "recompute"
    square = labels.select(F.col("celltype").alias("row"), F.explode(names).alias("col"))
    square = square.join(chosen.select("row", "col", F.col("value").cast("double").alias("value")), ["row", "col"], "left")
    square = square.select("row", "col", F.when(F.col("row") == F.col("col"), 0.0).otherwise(
        F.coalesce("value", F.lit(1.0))).alias("value"))
    return Anchors(written(full), written(square), origin_name)
