"""Neighbour edges, smoothing over neighbours, typical spacing, and close/far splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscape.functions.quantiles import quantile
from labelscape.operators.nearest import k_nearest, nearest_per_label
from labelscape.operators.radius import pairs_within
from labelscape.operators.spreading import vector_sums
from labelscape.session import written
from labelscape.sources.points import require


def radius_edges(points: DataFrame, radius: float, *, id_col: str = "cell_id", x_col: str = "x",
                 y_col: str = "y") -> DataFrame:
    """(id, neighbor, dist) for all ordered pairs of different points at most ``radius`` apart."""
    return pairs_within(points, [x_col, y_col], id_col, radius)


def neighbor_edges(points: DataFrame, *, id_col: str = "cell_id", x_col: str = "x", y_col: str = "y",
                   k_neighbors: int = 8, radius: float | None = None, strategy: str = "auto") -> DataFrame:
    """(id, neighbor): the k nearest other points, or all within ``radius`` when that is given.

    At least one neighbour is looked for. Ties go to the lower number, the point's own row never
    counts. Ids that are no whole numbers are numbered by their row.
    """
    require(points, [id_col, x_col, y_col])
    if radius is not None:
        return radius_edges(points, radius, id_col=id_col, x_col=x_col, y_col=y_col).select(id_col, "neighbor")
    k = max(1, int(k_neighbors))
    if dict(points.dtypes)[id_col] in {"bigint", "int", "smallint", "tinyint"}:
        return k_nearest(points, [x_col, y_col], id_col, k, strategy=strategy).select(id_col, "neighbor")
    # written once, so that every later use sees the same numbers
    names = written(points.select(id_col, x_col, y_col).withColumn("_number", F.monotonically_increasing_id()))
    found = k_nearest(names, [x_col, y_col], "_number", k, strategy=strategy)
    lookup = names.select("_number", id_col)
    return found.join(lookup, "_number").join(
        lookup.select(F.col("_number").alias("neighbor"), F.col(id_col).alias("_name")), "neighbor"
    ).select(id_col, F.col("_name").alias("neighbor"))


def smooth(values: DataFrame, edges: DataFrame, *, id_col: str = "cell_id", column: str = "gene",
           value: str = "value", include_self: bool = True, places: DataFrame | None = None) -> DataFrame:
    """Mean over neighbours (and self) per point and column; absent values count as 0.

    A point without neighbours keeps its own value. Only non-zero results are returned. ``places`` (id, x, y) lets neighbouring points share
    the vectors that they need.
    """
    edges, values = written(edges.select(id_col, "neighbor")), written(values.select(id_col, column, value))
    degree = edges.groupBy(id_col).agg(F.count("*").alias("_n"))
    own = values.select(F.col(id_col), F.col(column), F.col(value).alias("_self"), F.lit(None).cast("double").alias("_near"))
    near = vector_sums(values.select(F.col(id_col).alias("neighbor"), column, F.col(value).alias("_near")), edges, source="neighbor", keys=[id_col],
                       column=column, values=["_near"], places=None if places is None else places.select(id_col, "x", "y"))
    total = own.unionByName(near, allowMissingColumns=True).groupBy(id_col, column).agg(F.sum("_near").alias("_near"), F.sum("_self").alias("_self"))
    near, mine = F.coalesce("_near", F.lit(0.0)), F.coalesce("_self", F.lit(0.0))
    mean = (near + mine) / (F.col("_n") + 1) if include_self else near / F.col("_n")
    out = total.join(degree, id_col, "left").withColumn(
        value, F.when(F.col("_n").isNull(), mine).otherwise(mean))
    return out.where(F.col(value) != 0).select(id_col, column, value)


def spacing(points: DataFrame, *, id_col: str, x_col: str = "x", y_col: str = "y",
            strategy: str = "auto") -> DataFrame:
    """One row ``scale``: median distance to the nearest other point; 1 if that is not above 0."""
    near = k_nearest(points, [x_col, y_col], id_col, 1, strategy=strategy)
    return quantile(near, [], "dist", {"scale": 0.5}).agg(F.max("scale").alias("scale")).select(
        F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0).alias("scale"))


def split_by_distance(points: DataFrame, label_a: str, label_b: str, *, label_col: str = "celltype",
                      x_col: str = "x", y_col: str = "y", threshold: float | None = None,
                      strategy: str = "auto") -> DataFrame:
    """Add a label column where points of ``label_b`` become ``<b>_close`` or ``<b>_far``.

    Close means strictly nearer to the nearest ``label_a`` point than the threshold, by default
    the median over all ``label_b`` points.
    """
    require(points, [x_col, y_col, label_col])
    have = {r[0] for r in points.where(F.col(label_col).isin(label_a, label_b)).select(label_col).distinct().collect()}
    for wanted in (label_a, label_b):
        if wanted not in have:
            raise ValueError(f"{wanted!r} is not among the existing labels")
    new_col = f"split_{label_b}_by_{label_a}_in_{label_col}"
    to_a = points.where(F.col(label_col) == label_a)
    from_b = points.where(F.col(label_col) == label_b).select(x_col, y_col).distinct()
    near = nearest_per_label(from_b, to_a, [x_col, y_col], label_col, strategy=strategy).drop("target")
    out = points.join(near, [x_col, y_col], "left")
    own = F.col(label_col) == label_b
    if threshold is None:
        limit = quantile(out.where(own), [], "dist", {"limit": 0.5}).scalar()
    else:
        limit = F.lit(float(threshold))
    side = F.when(F.col("dist") < limit, F.lit(f"{label_b}_close")).otherwise(F.lit(f"{label_b}_far"))
    return out.withColumn(new_col, F.when(own, side).otherwise(F.col(label_col))).drop("dist")
