"""Directed label-to-label mean nearest-neighbour distances, plain and weighted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscape.functions.normalize import shifted_nonnegative
from labelscape.operators.nearest import nearest_per_label, nearest_sums
from labelscape.session import written
from labelscape.sources.points import require


def axes(x_col: str, y_col: str, z_col: str | None) -> list[str]:
    return [x_col, y_col] + ([z_col] if z_col else [])


def located(df: DataFrame, coords: list[str], label: str, weight: str | None = None, freq: str | None = None) -> DataFrame:
    """Distinct places per label with how many points (``n``) and how much weight (``w``) they hold. ``freq``: how often a row counts."""
    often = F.col(freq) if freq else F.lit(1)
    mass = F.sum(F.col(weight) * often) if weight else F.sum(often).cast("double")
    return df.where(F.col(label).isNotNull()).groupBy(
        F.col(label).cast("string").alias("source"), *[F.col(c).cast("double").alias(c) for c in coords]
    ).agg(F.sum(often).cast("long").alias("n"), mass.alias("w"))


def mean_by_source(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean distance from summed distances; the plain mean where the weights add up to nothing."""
    plain = F.sum("nd") / F.sum("n")
    return sums.groupBy(*keys).agg(F.when(F.sum("w") > 1e-8, F.sum("wd") / F.sum("w")).otherwise(plain).alias("value"))


def searcher_findee(points: DataFrame, *, x_col: str = "x", y_col: str = "y", z_col: str | None = None,
                    celltype_col: str = "celltype", strategy: str = "auto") -> DataFrame:
    """(source, target, value): mean distance from points of one label to the nearest of another."""
    coords = axes(x_col, y_col, z_col)
    require(points, [*coords, celltype_col])
    places = located(points, coords, celltype_col)
    near = nearest_sums(places, places, coords, "source", strategy=strategy)
    return mean_by_source(near, ["source", "target"])


def weighted_searcher_findee(points: DataFrame, *, x_col: str = "x", y_col: str = "y", z_col: str | None = None,
                             group_col: str = "celltype", weight_col: str | None = "weight",
                             min_weight: float = 0.0, strategy: str = "auto") -> DataFrame:
    """As ``searcher_findee``, rows averaged with the source points' weights; geometry unchanged.

    Weights below zero move the whole column up by its minimum; points at or below
    ``min_weight`` are no sources and no targets.
    """
    coords = axes(x_col, y_col, z_col)
    require(points, [*coords, group_col, *([weight_col] if weight_col else [])])
    if weight_col is None:
        weight_col = "_weight"
        points = points.withColumn(weight_col, F.lit(1.0))
    points = shifted_nonnegative(points, weight_col).where(F.col(weight_col) > float(min_weight))
    places = located(points, coords, group_col, weight_col)
    near = nearest_sums(places, places, coords, "source", strategy=strategy)
    return mean_by_source(near, ["source", "target"])


def between_tables(sources: DataFrame, targets: DataFrame, *, x_col: str = "x", y_col: str = "y",
                   source_label: str = "celltype", target_label: str = "celltype",
                   strategy: str = "auto") -> DataFrame:
    """Mean distance from the labels of one table to the nearest points of another table's labels."""
    require(sources, [x_col, y_col, source_label], "first table")
    require(targets, [x_col, y_col, target_label], "second table")
    coords = [x_col, y_col]
    near = nearest_sums(located(sources, coords, source_label), targets, coords, target_label, strategy=strategy)
    return mean_by_source(near, ["source", "target"])


def nearest_label_table(points: DataFrame, id_col: str, *, x_col: str = "x", y_col: str = "y",
                        z_col: str | None = None, celltype_col: str = "celltype",
                        strategy: str = "auto") -> DataFrame:
    """(id, source, target, dist): every single point's distance to the nearest point of each label."""
    coords = axes(x_col, y_col, z_col)
    require(points, [id_col, *coords, celltype_col])
    own = points.where(F.col(celltype_col).isNotNull()).select(
        id_col, F.col(celltype_col).cast("string").alias("source"), *coords)
    return nearest_per_label(own, points, coords, celltype_col, strategy=strategy).drop(*coords)


def drop_empty_columns(matrix: DataFrame) -> DataFrame:
    """Leave out targets that have no value at all."""
    kept = matrix.groupBy("target").agg(F.count("value").alias("_n")).where("_n > 0").select("target")
    return matrix.join(kept, "target", "left_semi")


def finite_block(matrix: DataFrame, *, dropna_axis: str = "both") -> DataFrame:
    """Infinite values become NULL; all-NULL rows/columns go by ``dropna_axis``; then any row with a
    NULL, then any column with one."""
    if dropna_axis not in {"rows", "index", "columns", "cols", "both", "none"}:
        raise ValueError(f"dropna_axis={dropna_axis!r} is unknown; use rows, columns, both or none")
    clean = written(matrix).withColumn("value", F.when(F.abs("value") < float("inf"), F.col("value")))
    if dropna_axis in {"rows", "index", "both"}:
        kept = clean.groupBy("source").agg(F.count("value").alias("_n")).where("_n > 0")
        clean = clean.join(kept, "source", "left_semi")
    if dropna_axis in {"columns", "cols", "both"}:
        clean = drop_empty_columns(clean)
    for axis in ("source", "target"):
        gaps = clean.where(F.col("value").isNull()).select(axis).distinct()
        clean = clean.join(gaps, axis, "left_anti")
    return clean


def mean_matrix(matrices: DataFrame, sample_col: str, *, strict: bool = True,
                keys: tuple[str, str] = ("source", "target")) -> DataFrame:
    """Mean of one matrix per sample; with ``strict`` a pair missing in any sample is NULL."""
    mean = F.avg("value")
    if strict:
        samples = matrices.agg(F.count_distinct(F.col(sample_col))).scalar()
        mean = F.when(F.count("value") == samples, F.avg("value"))
    return matrices.groupBy(*keys).agg(mean.alias("value"))


def complete(matrix: DataFrame, names: DataFrame, groups: list[str], *, keys: tuple[str, str] = ("source", "target")) -> DataFrame:
    """Every ordered pair of ``names`` for every group: an absent pair is 1, the diagonal 0. Label-sized."""
    everyone = names.agg(F.sort_array(F.collect_set("name"))).scalar()
    base = matrix.select(*groups).distinct() if groups else names.limit(1).select()
    grid = base.select(*groups, F.explode(everyone).alias(keys[0])).select("*", F.explode(everyone).alias(keys[1]))
    return grid.join(matrix, [*groups, *keys], "left").withColumn(
        "value", F.when(F.col(keys[0]) == F.col(keys[1]), 0.0).otherwise(F.coalesce("value", F.lit(1.0)))).select(*groups, *keys, "value")


def label_names(matrices: list[DataFrame], keys: tuple[str, str]) -> DataFrame:
    """Union of both axes of all matrices."""
    sides = [m.select(F.col(k).alias("name")) for m in matrices for k in keys]
    out = sides[0]
    for side in sides[1:]:
        out = out.union(side)
    return out.where("name is not null").distinct()


def stage_mean(matrices: DataFrame, stage_col: str, *, keys: tuple[str, str] = ("source", "target")) -> DataFrame:
    """(stage, source, target, value): one matrix per stage, the mean over its samples' entries, on the union of all labels."""
    mean = matrices.groupBy(stage_col, *keys).agg(F.avg("value").alias("value"))
    return complete(mean, label_names([matrices], keys), [stage_col], keys=keys)


def drift(before: DataFrame, after: DataFrame, *, keys: tuple[str, str] = ("source", "target")) -> tuple[DataFrame, DataFrame]:
    """Change of every entry (after - before, with its size), and the mean size per row.

    Both matrices count on the union of their labels: a pair that one of them lacks is 1 there, the diagonal 0.
    """
    names = label_names([before, after], keys)
    one, other = complete(before, names, [], keys=keys), complete(after, names, [], keys=keys)
    delta = other.withColumnRenamed("value", "_after").join(one.withColumnRenamed("value", "_before"), list(keys)).select(
        *keys, (F.col("_after") - F.col("_before")).alias("delta")).withColumn("abs_delta", F.abs("delta"))
    return delta, delta.groupBy(keys[0]).agg(F.avg("abs_delta").alias("mean_abs_delta"))
