"""Figures of label-sized results: the data step in Spark, drawing only if matplotlib is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscape.operators.structure import leaf_positions, newick

# Titles, default file names and axis names by kind of matrix.
TITLES = {
    "row_coph": ("StructureMap of {sample}", "StructureMap_of_{sample}.pdf", "Searcher", "Searcher"),
    "col_coph": ("Findee's D score of {sample}", "Findee_D_score_of_{sample}.pdf", "Findee", "Findee"),
    "other": ("D score of {sample}", "D_score_of_{sample}.pdf", "Findee", "Searcher"),
}


def heatmap_data(matrix: DataFrame, *, row: str = "row", col: str = "col", method: str = "average") -> DataFrame:
    """(row, col, value, row_position, col_position) in clustered order of both axes."""
    plain = matrix.select(F.col(row).alias("source"), F.col(col).alias("target"), "value")
    rows = leaf_positions(plain, method=method).select(F.col("label").alias("source"), F.col("position").alias("row_position"))
    cols = leaf_positions(plain, method=method, axis="col").select(
        F.col("label").alias("target"), F.col("position").alias("col_position"))
    return plain.join(rows, "source").join(cols, "target").select(
        F.col("source").alias(row), F.col("target").alias(col), "value", "row_position", "col_position")


def circle_data(background: DataFrame, circles: DataFrame, *, exponent: float = 1.0, max_area: float = 200.0,
                row: str = "row", col: str = "col") -> DataFrame:
    """Heatmap values with a circle area per cell: share of 100, clipped, to the power, times ``max_area``."""
    share = F.least(F.greatest(F.col("percent") / 100, F.lit(0.0)), F.lit(1.0))
    sizes = circles.select(row, col, F.col("value").alias("percent"))
    both = background.join(sizes, [row, col], "full")
    if not both.where(F.col("value").isNull() | F.col("percent").isNull()).isEmpty():
        raise ValueError("background and circles must have the same rows and columns")
    return both.withColumn("area", F.pow(share, F.lit(float(exponent))) * max_area)


def titles(kind: str, sample: str) -> tuple[str, str, str, str]:
    return tuple(part.format(sample=sample) for part in TITLES.get(kind, TITLES["other"]))


def draw_heatmap(matrix: DataFrame, output: str, *, kind: str = "row_coph", sample: str = "Sample", row: str = "row",
                 col: str = "col", method: str = "average", cmap: str = "RdBu") -> str:
    """Clustered heatmap as a file; needs matplotlib on the driver."""
    try:
        import matplotlib.pyplot as plt
    except ImportError as error:
        raise ImportError("drawing needs matplotlib; heatmap_data gives the ordered values without it") from error
    pdf = heatmap_data(matrix, row=row, col=col, method=method).toPandas()
    square = pdf.pivot(index="row_position", columns="col_position", values="value")
    names = pdf.drop_duplicates("row_position").sort_values("row_position")[row]
    others = pdf.drop_duplicates("col_position").sort_values("col_position")[col]
    title, _, x_name, y_name = titles(kind, sample)
    figure, axis = plt.subplots(figsize=(max(8.0, 0.25 * len(others) + 0.5), max(8.0, 0.25 * len(names) + 0.5)))
    axis.figure.colorbar(axis.imshow(square, cmap=cmap))
    axis.set_xticks(range(len(others)), others, rotation=90)
    axis.set_yticks(range(len(names)), names)
    axis.set(title=title, xlabel=x_name, ylabel=y_name)
    figure.savefig(output, bbox_inches="tight")
    plt.close(figure)
    return output


def tree_text(matrix: DataFrame, *, row: str = "row", col: str = "col", method: str = "average",
              metric: str = "euclidean") -> str:
    """The circular dendrogram's tree in text form."""
    plain = matrix.select(F.col(row).alias("source"), F.col(col).alias("target"), "value")
    return newick(plain, method=method, metric=metric).first()["newick"]
