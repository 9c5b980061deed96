"""Gene-to-gene distance matrices over expression-weighted spots.

Inputs are a long expression table (spot, gene, value) and a spot table with coordinates. Results
are long matrices (source, target, value); pairs without expression are absent unless said.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscape.functions.quantiles import aggregate_distances
from labelscape.operators.nearest import BROADCAST_ROWS, cheapest, nearest_per_label, nearest_sums
from labelscape.operators.neighbors import spacing
from labelscape.session import written
from labelscape.sources.points import require

#: Centroids in a block, and spots in a block that meets it.
CENTRE_CHUNK, SPOT_BLOCK = 65_536, 200_000
#: Distances held at once, and spots of a gene that go to one task.
CELLS, SLICE = 4_000_000, 16_384


def _placed(expression: DataFrame, spots: DataFrame, threshold: float, coords: list[str], spot_col: str) -> DataFrame:
    require(expression, [spot_col, "gene", "value"], "expression")
    require(spots, [spot_col, *coords], "coordinates")
    return expression.where(F.col("value") > float(threshold)).select(spot_col, "gene", "value").join(
        spots.select(spot_col, *[F.col(c).cast("double").alias(c) for c in coords]), spot_col).drop(spot_col)


def _axes(z_col: str | None) -> list[str]:
    return ["x", "y"] + ([z_col] if z_col else [])


def ewnn(expression: DataFrame, spots: DataFrame, *, threshold: float = 0.0, z_col: str | None = None,
         spot_col: str = "cell_id", strategy: str = "auto") -> DataFrame:
    """Smallest cost d / (sqrt(E_i) * sqrt(E_j)) + 1e-8 between spots of gene i and spots of gene j."""
    if threshold < 0:
        raise ValueError("threshold must not be negative, costs divide by the root of the expression")
    coords = _axes(z_col)
    placed = _placed(expression, spots, threshold, coords, spot_col)
    scaled = placed.select("gene", *coords, (1 / F.sqrt("value")).alias("scale"))
    sources = scaled.groupBy(F.col("gene").alias("source"), *coords).agg(F.min("scale").alias("scale"))
    costs = cheapest(sources, scaled, coords, "gene", factor="scale", strategy=strategy)
    return costs.groupBy("source", "target").agg((F.min("cost") + 1e-8).alias("value"))


def weighted_nearest(expression: DataFrame, spots: DataFrame, *, threshold: float = 0.0, z_col: str | None = None,
                     spot_col: str = "cell_id", strategy: str = "auto") -> DataFrame:
    """Expression-weighted mean distance from gene i's spots to the nearest spot of gene j."""
    coords = _axes(z_col)
    placed = _placed(expression, spots, threshold, coords, spot_col)
    sources = placed.groupBy(F.col("gene").alias("source"), *coords).agg(F.count("*").alias("n"), F.sum("value").alias("w"))
    sums = nearest_sums(sources.where("source is not null"), placed, coords, "gene", strategy=strategy)
    return sums.groupBy("source", "target").agg(F.try_divide(F.sum("wd"), F.sum("w")).alias("value"))


def wmda(expression: DataFrame, spots: DataFrame, *, threshold: float = 0.0, z_col: str | None = None,
         spot_col: str = "cell_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Expression-weighted mean distance from gene i's spots to gene j's weighted centroid.

    Centroids are one row per gene. Up to ``broadcast_rows`` of them go to every task; a gene's spots are dealt to as many tasks as its number of
    spots asks for. Beyond, blocks of spots meet blocks of centroids. Either way distances are added up inside the task.
    """
    coords = _axes(z_col)
    placed = written(_placed(expression, spots, threshold, coords, spot_col).where("gene is not null"))
    centres = written(placed.groupBy("gene").agg(
        *[F.try_divide(F.sum(F.col(c) * F.col("value")), F.sum("value")).alias(c) for c in coords], F.count("*").alias("spots")))
    rows = placed.groupBy(F.col("gene").alias("source"), *coords).agg(F.sum("value").alias("w"))
    table = centres.limit(broadcast_rows + 1).toArrow()
    if table.num_rows <= broadcast_rows:
        sums = _to_centres(rows, centres, table, coords)
    else:
        sums = _to_centre_blocks(written(rows), centres, coords)
    whole = rows.groupBy("source").agg(F.sum("w").alias("w"))
    value = F.try_divide(F.when(~F.isnan("wd"), F.col("wd")), F.col("w"))  # a target whose weights add up to 0 has no centre
    return sums.groupBy("source", "target").agg(F.sum("wd").alias("wd")).join(whole, "source").select(
        "source", "target", value.alias("value"))


def _matrix(batch: pa.RecordBatch | pa.Table, columns: list[str]) -> np.ndarray:
    return np.stack([np.asarray(batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=float) for c in columns], axis=1)


def _runs(source: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and stop of the runs of equal neighbours."""
    cuts = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1], [True]])) if len(source) else []
    return zip(cuts, cuts[1:])


def _add_up(xyz: np.ndarray, weight: np.ndarray, centres: np.ndarray, total: np.ndarray) -> None:
    """Add the weighted distances of some spots to each centre, at most CELLS of them at a time."""
    step = max(1, CELLS // max(1, len(centres)))
    for at in range(0, len(xyz), step):
        square = sum((xyz[at:at + step, i, None] - centres[None, :, i]) ** 2 for i in range(centres.shape[1]))
        total += weight[at:at + step] @ np.sqrt(square)


def _sums(source: str, targets: pa.Array, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(source, pa.string()), len(targets)), targets, pa.array(total)],
                                      ["source", "target", "wd"])


def _to_centres(rows: DataFrame, centres: DataFrame, table: pa.Table, coords: list[str]) -> DataFrame:
    """(source, target, wd), one row a task for each of its sources and every target."""
    shared = rows.sparkSession.sparkContext.broadcast((table.column("gene").to_pylist(), _matrix(table, coords)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, places = shared.value
        targets = pa.array(names, pa.string())
        now, total = None, None
        for batch in batches:
            xyz, weight = _matrix(batch, coords), _matrix(batch, ["w"])[:, 0]
            # rows come sorted by source, so each is one run
            source = batch.column("source").to_numpy(zero_copy_only=False)
            for start, stop in _runs(source):
                if source[start] != now:
                    if now is not None:
                        yield _sums(now, targets, total)
                    now, total = source[start], np.zeros(len(targets))
                _add_up(xyz[start:stop], weight[start:stop], places, total)
        if now is not None:
            yield _sums(now, targets, total)

    # the counts are a row for each centre, and there are few enough of those
    slices = centres.select(F.col("gene").alias("source"), F.ceil(F.col("spots") / SLICE).alias("_slices"))
    dealt = rows.join(F.broadcast(slices), "source").withColumn("_slice", F.pmod(F.xxhash64(*coords), F.col("_slices")))
    return dealt.repartition("source", "_slice").sortWithinPartitions("source").select("source", *coords, "w").mapInArrow(
        add, "source string, target string, wd double")


def _to_centre_blocks(rows: DataFrame, centres: DataFrame, coords: list[str]) -> DataFrame:
    """The same with centroids in blocks: spots in blocks of bounded size, cut by range so that a gene is few or as many as it needs."""
    chunks = max(1, -(-centres.count() // CENTRE_CHUNK))
    groups = max(1, -(-rows.count() // SPOT_BLOCK))
    blocks = written(rows.repartitionByRange(groups, "source", *coords).withColumn("block", F.spark_partition_id()))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    own = blocks.select("block", every(chunks).alias("chunk"), F.lit(1).alias("role"), "source", *coords, "w")
    other = centres.select(every(groups).alias("block"), F.pmod(F.xxhash64("gene"), F.lit(chunks)).cast("int").alias("chunk"),
                           F.lit(0).alias("role"), F.col("gene").alias("source"), *coords, F.lit(None).cast("double").alias("w"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # centroids of a unit come first, then its spots by source
        unit, now, total, targets, places, parts = None, None, None, None, None, []
        for batch in batches:
            xyz, weight = _matrix(batch, coords), _matrix(batch, ["w"])[:, 0]
            source = batch.column("source").to_numpy(zero_copy_only=False)
            keys = np.stack([batch.column(c).to_numpy() for c in ("block", "chunk", "role")], axis=1)
            cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]])) if len(source) else []
            for first, last in zip(cuts, cuts[1:]):
                *key, role = keys[first].tolist()
                if key != unit:
                    if total is not None:
                        yield _sums(now, targets, total)
                    unit, now, total, targets, parts = key, None, None, None, []
                if role == 0:
                    parts.append((source[first:last], xyz[first:last]))
                    continue
                if not parts and targets is None:
                    continue
                if targets is None:
                    targets, places, parts = pa.array(np.concatenate([n for n, _ in parts]), pa.string()), np.concatenate([c for _, c in parts]), []
                for start, stop in _runs(source[first:last]):
                    if source[first + start] != now:
                        if total is not None:
                            yield _sums(now, targets, total)
                        now, total = source[first + start], np.zeros(len(targets))
                    _add_up(xyz[first + start:first + stop], weight[first + start:first + stop], places, total)
        if total is not None:
            yield _sums(now, targets, total)

    unit = ["block", "chunk"]
    return own.unionByName(other).repartition(groups * chunks, *unit).sortWithinPartitions(*unit, "role", "source").mapInArrow(
        add, "source string, target string, wd double")


def visium(expression: DataFrame, spots: DataFrame, *, genes: DataFrame | None = None, threshold: float = 0.0,
           min_spots: int = 20, min_total_expr: float = 0.0, agg: str = "quantile", quantile: float = 0.9,
           weight_by_expression: bool = True, symmetric: str = "min", spot_col: str = "cell_id",
           strategy: str = "auto") -> DataFrame:
    """Aggregated nearest-neighbour distance from gene i's to gene j's spots, in units of the spacing.

    Every pair of the gene list has a row. A source gene with fewer than ``min_spots`` spots or a
    total at or below ``min_total_expr`` gives NULL; a target with too few spots gives infinity.
    ``symmetric``: none, or the smaller / the mean of both directions where known; the diagonal is 0.
    """
    if symmetric not in {"none", "min", "mean"}:
        raise ValueError(f"{symmetric!r} is no way to make a matrix symmetric; there are none, min and mean")
    coords = ["x", "y"]
    expression = written(expression)  # it may be a long join, and is read for the names and the places
    names = (genes if genes is not None else expression.select("gene")).distinct()
    names = written(names.select(F.col(names.columns[0]).cast("string").alias("gene")))
    placed = written(_placed(expression.join(names, "gene", "left_semi"), spots, threshold, coords, spot_col))
    held = placed.groupBy("gene").agg(F.count("*").alias("spots"), F.sum("value").alias("total"))
    wide = F.coalesce("spots", F.lit(0)) >= min_spots
    status = names.join(held, "gene", "left").select(
        "gene", wide.alias("reachable"), (wide & (F.coalesce("total", F.lit(0.0)) > min_total_expr)).alias("dense"))
    status = written(status)
    # spots of one gene with equal places and values are one row with their number
    equal = placed.groupBy("gene", *coords, "value").agg(F.count("*").alias("_n"))
    sources = equal.join(status.where("dense").select("gene"), "gene", "left_semi")
    targets = placed.join(status.where("reachable").select("gene"), "gene", "left_semi")
    near = nearest_per_label(sources.withColumnRenamed("gene", "source"), targets, coords, "gene", strategy=strategy)
    far = aggregate_distances(near.where("source <> target"), ["source", "target"], "dist", "value",
                              agg=agg, q=quantile, weight_by_expression=weight_by_expression, freq="_n")
    unit = spacing(spots, id_col=spot_col, strategy=strategy).scalar()
    others = names.agg(F.collect_list("gene")).scalar()
    grid = names.select(F.col("gene").alias("source"), F.explode(others).alias("target"))
    grid = grid.join(status.select(F.col("gene").alias("source"), "dense"), "source")
    grid = grid.join(status.select(F.col("gene").alias("target"), "reachable"), "target")
    value = (F.when(~F.col("dense"), F.lit(None).cast("double"))
             .when(F.col("source") == F.col("target"), 0.0)
             .when(~F.col("reachable"), float("inf"))
             .otherwise(F.col("value") / unit))
    directed = grid.join(far, ["source", "target"], "left").select("source", "target", value.alias("value"))
    return directed if symmetric == "none" else symmetrized(directed, symmetric)


def symmetrized(matrix: DataFrame, how: str = "min") -> DataFrame:
    """Both directions get their smaller value or their mean, ignoring NULL; the diagonal is 0."""
    back = matrix.select(F.col("source").alias("target"), F.col("target").alias("source"), F.col("value").alias("_back"))
    both = F.least("value", "_back") if how == "min" else F.coalesce(
        (F.col("value") + F.col("_back")) / 2, "value", "_back")
    return matrix.join(back, ["source", "target"]).select("source", "target", F.when(
        F.col("source") == F.col("target"), 0.0).otherwise(both).alias("value"))
