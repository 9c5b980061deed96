"""Weighted entities (genes, pathways) placed relative to the labels of a reference table.

Adding an entity to a label matrix only adds its own row and column, so the label block and the
distances between its rows are computed once for all entities; each entity then contributes two short
vectors, and one small clustering per entity runs in parallel over the entities.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscape.functions import linkage as link
from labelscape.functions.normalize import shifted_nonnegative
from labelscape.operators.matrices import axes, located, mean_by_source, searcher_findee, weighted_searcher_findee
from labelscape.operators.nearest import nearest_sums
from labelscape.operators.structure import structure_map
from labelscape.session import written
from labelscape.sources.points import dense, require


#: Entries of a label matrix that may pass the driver.
BLOCK_ROWS = 1_000_000


def entity_points(reference: DataFrame, expression: DataFrame, *, entities: DataFrame | None = None,
                  min_weight: float = 0.0) -> DataFrame:
    """(cell_id, x, y, celltype, entity, weight) for every cell where the entity exceeds ``min_weight``.

    An entity with negative values moves up by its minimum, its absent cells included.
    """
    if entities is not None:
        names = entities.select(F.col(entities.columns[0]).cast("string").alias("gene")).distinct()
        expression = expression.join(names, "gene", "left_semi")
    shift = expression.groupBy("gene").agg(F.least(F.min("value"), F.lit(0.0)).alias("_low"))
    every = shift.select("gene") if min_weight < 0 else shift.where("_low < 0").select("gene")
    moved = dense(reference, every, expression)
    plain = expression.join(every, "gene", "left_anti").select("cell_id", "gene", "value")
    weighed = plain.unionByName(moved.select("cell_id", "gene", "value")).join(shift, "gene")
    weighed = weighed.withColumn("weight", F.greatest(F.col("value") - F.col("_low"), F.lit(0.0)))
    return reference.join(weighed.where(F.col("weight") > float(min_weight)), "cell_id").select(
        "cell_id", "x", "y", "celltype", F.col("gene").alias("entity"), "weight")


class LabelBlock:
    """The label matrix and the squared distances between its rows, made once for all entities."""

    def __init__(self, labels: list[str], block: np.ndarray):
        self.labels, self.block = labels, block
        self.squares = link.row_distances(block, "sqeuclidean")

    @classmethod
    def of(cls, square: pa.Table) -> LabelBlock:
        """From rows of source, target, value."""
        coded = [square.column(c).combine_chunks().dictionary_encode() for c in ("source", "target")]
        names = sorted(coded[0].dictionary.to_pylist())
        at = {name: i for i, name in enumerate(names)}
        block = np.zeros((len(names), len(names)))
        place = [np.array([at[name] for name in c.dictionary.to_pylist()], np.int64)[c.indices.to_numpy()] for c in coded]
        block[place[0], place[1]] = square.column("value").to_numpy()
        return cls(names, block)

    def entity_row(self, entity: str, out: list[float], back: list[float], method: str) -> np.ndarray:
        """Cophenetic row of one entity over the labels, from the label block and the entity's own vectors."""
        at = bisect_left(self.labels, entity)
        if at < len(self.labels) and self.labels[at] == entity:
            full = self.block.copy()
            full[at, :], full[:, at] = out, back
            full[at, at] = 0.0
            return link.structure_map(full, method)[at]
        merges = link.linkage(link.with_one_more(self.squares, self.block, np.array(out), np.array(back), at), method)
        row = np.delete(link.cophenetic_row(merges, at), at)
        high = merges[:, 2].max()
        return row / high if high > 0 else row  # the smallest entry of the map is the 0 of its diagonal


def entity_to_cell(reference: DataFrame, entities: DataFrame, *, x_col: str = "x", y_col: str = "y",
                   z_col: str | None = None, celltype_col: str = "celltype", entity_col: str = "entity",
                   weight_col: str = "weight", min_weight: float = 0.0, method: str = "average",
                   strategy: str = "auto", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(entity, celltype, value): cophenetic distance of every entity to every label.

    An entity without points above ``min_weight`` gets NULLs. An entity named like a label shares that label's points. Reference points
    weigh 1: from a ``min_weight`` of 1 on none of them counts, and only an entity's distance to a label of its own name, 0, is left.
    A label matrix of at most ``block_rows`` entries is sent to every task; a larger one reaches the tasks by a shuffle.
    """
    coords = axes(x_col, y_col, z_col)
    require(reference, [*coords, celltype_col], "reference")
    require(entities, [*coords, entity_col, weight_col], "entity points")
    if method not in link.METHODS:
        raise ValueError(f"clustering method {method!r} is not known: {', '.join(link.METHODS)}")
    cells = reference.where(F.col(celltype_col).isNotNull()).select(
        *coords, F.col(celltype_col).cast("string").alias("celltype"))
    # equal points are one row with their number from here on
    cloud = shifted_nonnegative(written(entities.groupBy(
        *coords, F.col(entity_col).cast("string").alias("entity"), F.col(weight_col).alias("weight")).agg(F.count("*").alias("_n"))), "weight")
    everyone = cloud.select("entity").distinct()
    cloud = cloud.where(F.col("weight") > float(min_weight))
    if min_weight >= 1:
        every_label = cells.agg(F.sort_array(F.collect_set("celltype"))).scalar()
        held = cloud.select("entity", F.col("entity").alias("celltype"), F.lit(0.0).alias("value")).distinct()
        return everyone.select("entity", F.explode(every_label).alias("celltype")).join(held, ["entity", "celltype"], "left")
    namesakes = cells.join(cloud.select(F.col("entity").alias("celltype")).distinct(), "celltype", "left_semi")
    cloud = cloud.unionByName(namesakes.select(*coords, F.col("celltype").alias("entity"), F.lit(1.0).alias("weight"), F.lit(1).cast("long").alias("_n")))

    cells, cloud = written(cells), written(cloud)
    block = searcher_findee(cells, x_col=x_col, y_col=y_col, z_col=z_col, celltype_col="celltype", strategy=strategy)
    outward = mean_by_source(nearest_sums(
        located(cloud, coords, "entity", "weight", freq="_n"), cells, coords, "celltype", strategy=strategy), ["source", "target"])
    inward = mean_by_source(nearest_sums(
        located(cells, coords, "celltype"), cloud, coords, "entity", strategy=strategy), ["source", "target"])

    def listed(matrix: DataFrame, entity: str, label: str, name: str) -> DataFrame:
        return matrix.groupBy(F.col(entity).alias("entity")).agg(
            F.sort_array(F.collect_list(F.struct(F.col(label).alias("k"), F.col("value").alias("v")))).alias(name))

    def placed_rows(labels: LabelBlock, entities: Iterator[tuple[str, list, list]]) -> Iterator[pa.RecordBatch]:
        for name, out, back in entities:
            found = labels.entity_row(name, [e["v"] for e in out], [e["v"] for e in back], method)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(name, len(found)), pa.array(labels.labels, pa.string()), pa.array(found, pa.float64())],
                ["entity", "celltype", "value"])

    vectors = listed(outward, "source", "target", "_out").join(listed(inward, "target", "source", "_in"), "entity").select("entity", "_out", "_in")
    kind = "entity string, celltype string, value double"
    block = written(block)
    if block.count() <= block_rows:
        shared = reference.sparkSession.sparkContext.broadcast(block.toArrow())

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            labels = LabelBlock.of(shared.value)
            for batch in batches:
                yield from placed_rows(labels, zip(*(batch.column(i).to_pylist() for i in range(3))))

        placed = vectors.mapInArrow(rows, kind)
    else:
        # a larger block does not pass the driver: a copy goes to each of as many shares of the entities as there are tasks
        shares = int(reference.sparkSession.conf.get("spark.sql.shuffle.partitions"))

        def share(entities: pa.Table, square: pa.Table) -> pa.Table:
            if not entities.num_rows:
                return pa.table([pa.array([], t) for t in (pa.string(), pa.string(), pa.float64())], ["entity", "celltype", "value"])
            return pa.Table.from_batches(placed_rows(LabelBlock.of(square), zip(*(entities.column(c).to_pylist() for c in ("entity", "_out", "_in")))))

        copies = block.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        placed = vectors.withColumn("_share", F.pmod(F.xxhash64("entity"), F.lit(shares)).cast("int")).groupBy("_share").cogroup(
            copies.groupBy("_copy")).applyInArrow(share, kind)
    labels = cells.agg(F.sort_array(F.collect_set("celltype"))).scalar()
    empty = everyone.join(cloud.select("entity").distinct(), "entity", "left_anti").select(
        "entity", F.explode(labels).alias("celltype"), F.lit(None).cast("double").alias("value"))
    return placed.unionByName(empty)


def entity_structuremap(entities: DataFrame, *, x_col: str = "x", y_col: str = "y", z_col: str | None = None,
                        entity_col: str = "entity", weight_col: str = "weight", min_weight: float = 0.0,
                        method: str = "average", strategy: str = "auto") -> DataFrame:
    """(row, col, value): structure map of the entities' own weighted clouds."""
    matrix = weighted_searcher_findee(written(entities), x_col=x_col, y_col=y_col, z_col=z_col, group_col=entity_col,
                                      weight_col=weight_col, min_weight=min_weight, strategy=strategy)
    return structure_map(matrix, method=method)


def transcript_to_cell(cells: DataFrame, transcripts: DataFrame, *, genes: DataFrame | None = None,
                       method: str = "average", strategy: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(structure map of the cells, (gene, celltype, value) for every gene).

    ``transcripts`` has x, y, feature_name. A listed gene without transcripts takes the structure map's
    row if it is a label, else NULLs. A gene's own label is left out of its row.
    """
    base = structure_map(searcher_findee(cells, strategy=strategy), method=method)
    points = transcripts.select("x", "y", F.col("feature_name").alias("entity"), F.lit(1.0).alias("weight"))
    if genes is not None:
        genes = genes.select(F.col(genes.columns[0]).cast("string").alias("gene")).distinct()
        points = points.join(genes.withColumnRenamed("gene", "entity"), "entity", "left_semi")
    found = entity_to_cell(cells, points, method=method, strategy=strategy)
    found = found.select(F.col("entity").alias("gene"), "celltype", "value")
    if genes is not None:
        silent = genes.join(points.select(F.col("entity").alias("gene")).distinct(), "gene", "left_anti")
        labels = cells.agg(F.collect_set("celltype")).scalar()
        rows = silent.select("gene", F.explode(labels).alias("celltype")).join(
            base.select(F.col("row").alias("gene"), F.col("col").alias("celltype"), "value"),
            ["gene", "celltype"], "left")
        found = found.unionByName(rows.select("gene", "celltype", "value"))
    return base, found.where("gene <> celltype")
