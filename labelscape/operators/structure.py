"""Structure maps: cophenetic distances of clustered label matrices, scaled to [0, 1].

The clustering input is a matrix of labels, not of points; a task holds the matrix of one group (sample, entity), whose size is
the square of the number of distinct labels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelscape.functions import linkage as link
from labelscape.session import written


def profile_distances(matrix: DataFrame, axis: str = "row") -> DataFrame:
    """Euclidean distance between every two rows (or columns) of a label matrix."""
    own, other = ("source", "target") if axis == "row" else ("target", "source")
    a = matrix.select(F.col(own).alias("label_a"), F.col(other).alias("_k"), F.col("value").alias("_a"))
    b = matrix.select(F.col(own).alias("label_b"), F.col(other).alias("_k"), F.col("value").alias("_b"))
    gap = F.col("_a") - F.col("_b")
    return a.join(b, "_k").groupBy("label_a", "label_b").agg(F.sqrt(F.sum(gap * gap)).alias("value"))


def _profiles(matrix: DataFrame, groups: list[str], axis: str) -> DataFrame:
    """One row per label: its values sorted by the other axis."""
    own, other = ("source", "target") if axis == "row" else ("target", "source")
    entry = F.struct(F.col(other).alias("k"), F.col("value").alias("v"))
    rows = matrix.groupBy(*groups, F.col(own).alias("label")).agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    return rows.select(*groups, "label", F.col("_e.v").alias("values"))


def _square(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    pdf = pdf.sort_values("label", kind="stable")
    if pdf["values"].map(len).nunique() > 1:
        raise ValueError("the label matrix has missing entries")
    return list(pdf["label"]), np.stack([np.asarray(v, dtype=float) for v in pdf["values"]])


def _long(labels: list[str], square: np.ndarray) -> dict:
    n = len(labels)
    return {"row": np.repeat(labels, n), "col": np.tile(labels, n), "value": square.ravel()}


def _grouped(matrix: DataFrame, groups: list[str], axis: str):
    rows = _profiles(matrix, groups, axis)
    if not groups:
        rows = rows.withColumn("_all", F.lit(0))
    return rows.groupBy(*(groups or ["_all"]))


def _schema(matrix: DataFrame, groups: list[str], text: str) -> T.StructType:
    out = T.StructType([matrix.schema[g] for g in groups])
    for part in text.split(","):
        name, kind = part.split()
        out = out.add(name, kind)
    return out


def structure_map(matrix: DataFrame, *, method: str = "average", axis: str = "row",
                  groups: list[str] | None = None, single: str = "error") -> DataFrame:
    """(groups, row, col, value) from (groups, source, target, value).

    Rows (``axis="row"``) or columns are the observation vectors. ``single="zero"`` gives [[0]]
    for a matrix with one label; by default that is an error.
    """
    groups = groups or []
    if method not in link.METHODS:
        raise ValueError(f"clustering method {method!r} is not known: {', '.join(link.METHODS)}")

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        labels, rows = _square(pdf)
        if len(labels) == 1 and single == "zero":
            square = np.zeros((1, 1))
        else:
            square = link.structure_map(rows, method)
        keys = {g: pdf[g].iloc[0] for g in groups}
        return pd.DataFrame({**_long(labels, square)}).assign(**keys)[[*groups, "row", "col", "value"]]

    return _grouped(matrix, groups, axis).applyInPandas(
        cluster, _schema(matrix, groups, "row string,col string,value double"))


def cophenetic_correlation(matrix: DataFrame, *, method: str = "average", axis: str = "row",
                           groups: list[str] | None = None) -> DataFrame:
    """Correlation between profile distances and cophenetic distances."""
    groups = groups or []

    def correlate(pdf: pd.DataFrame) -> pd.DataFrame:
        _, rows = _square(pdf)
        distances = link.row_distances(rows)
        heights = link.cophenetic(link.linkage(distances, method))
        keys = {g: [pdf[g].iloc[0]] for g in groups}
        return pd.DataFrame({**keys, "correlation": [link.cophenetic_correlation(distances, heights)]})

    return _grouped(matrix, groups, axis).applyInPandas(correlate, _schema(matrix, groups, "correlation double"))


def fill_missing(matrix: DataFrame) -> DataFrame:
    """NULL entries take their column's mean, else the overall mean, else 0."""
    matrix = written(matrix)
    value = F.when(~F.isnan("value"), F.col("value"))
    overall = matrix.agg(F.avg(value)).scalar()
    column = F.avg(value).over(Window.partitionBy("target"))
    return matrix.withColumn("value", F.coalesce(value, column, overall, F.lit(0.0)))


def cophenetic_from_mean_matrix(matrix: DataFrame, *, method: str = "average", metric: str = "euclidean",
                                normalize: bool = True, axis: str = "row") -> DataFrame:
    """As ``structure_map`` from a matrix with gaps, any metric, 0 diagonal; constant maps give 0."""
    if not isinstance(matrix, DataFrame):
        raise TypeError("matrix must be a DataFrame of source, target, value")
    if metric not in link.METRICS:
        raise ValueError(f"metric {metric!r} is not known: {', '.join(link.METRICS)}")

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        labels, rows = _square(pdf)
        square = np.zeros((len(labels), len(labels)))
        if len(labels) > 1:
            square = link.cophenetic(link.linkage(link.row_distances(rows, metric), method))
        if normalize:
            low, high = square.min(), square.max()
            square = (square - low) / (high - low) if high > low else np.zeros_like(square)
            np.fill_diagonal(square, 0.0)
        return pd.DataFrame(_long(labels, square))

    return _grouped(fill_missing(matrix), [], axis).applyInPandas(cluster, "row string, col string, value double")


def dendrogram(matrix: DataFrame, *, method: str = "average", axis: str = "col") -> DataFrame:
    """Tree as a flat node table: node_id, parent_id, side, name, dist, score.

    Both children of a split at depth L (the root is depth 1) score 1/2^(L-1); the root scores NULL.
    """

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        labels, rows = _square(pdf)
        merges = link.linkage(link.row_distances(rows), method)
        n = len(labels)
        root = 2 * n - 2
        out = [(root, None, None, None, merges[-1, 2], None)]
        stack = [(root, 1)]
        while stack:
            node, depth = stack.pop()
            for side, child in zip(("left", "right"), merges[node - n, :2].astype(int)):
                leaf = child < n
                out.append((int(child), int(node), side, labels[child] if leaf else None,
                            0.0 if leaf else float(merges[child - n, 2]), 0.5 ** (depth - 1)))
                if not leaf:
                    stack.append((int(child), depth + 1))
        frame = pd.DataFrame(out, columns=["node_id", "parent_id", "side", "name", "dist", "score"])
        return frame.astype({"parent_id": "Int64", "score": "Float64"})

    return _grouped(matrix, [], axis).applyInPandas(
        grow, "node_id long, parent_id long, side string, name string, dist double, score double")


def dendrogram_dict(nodes: DataFrame) -> dict:
    """Nested id/name/dist/score/left/right form of a node table (label-sized, on the driver)."""
    rows = {r["node_id"]: r for r in nodes.collect()}
    children: dict = {}
    for r in rows.values():
        if r["parent_id"] is not None:
            children.setdefault(r["parent_id"], {})[r["side"]] = r["node_id"]

    def build(node: int) -> dict:
        r = rows[node]
        out = {"id": node, "dist": r["dist"], "score": r["score"]}
        if node not in children:
            return {"id": node, "name": r["name"], "dist": r["dist"], "score": r["score"]}
        out.update({side: build(child) for side, child in children[node].items()})
        return out

    return build(next(i for i, r in rows.items() if r["parent_id"] is None))


def newick(matrix: DataFrame, *, method: str = "average", metric: str = "euclidean") -> DataFrame:
    """One row: the tree of the matrix rows as text, and the leaves in drawn order.

    A symmetric square matrix is clustered by its rows as vectors like any other.
    """

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        labels, rows = _square(pdf)
        symmetric = rows.shape[0] == rows.shape[1] and np.allclose(rows, rows.T, atol=1e-8)
        vectors = rows if symmetric else link.row_distances(rows, metric)
        merges = link.linkage(link.row_distances(vectors), method)
        order = [labels[i] for i in link.leaf_order(merges)]
        return pd.DataFrame({"newick": [link.newick(merges, labels)], "leaves": [order]})

    return _grouped(matrix, [], "row").applyInPandas(write, "newick string, leaves array<string>")


def leaf_positions(matrix: DataFrame, *, method: str = "average", axis: str = "row") -> DataFrame:
    """(label, position): order of rows or columns in a clustered heatmap."""

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        labels, rows = _square(pdf)
        leaves = link.leaf_order(link.linkage(link.row_distances(rows), method))
        return pd.DataFrame({"label": [labels[i] for i in leaves], "position": np.arange(len(leaves))})

    return _grouped(matrix, [], axis).applyInPandas(order, "label string, position int")
